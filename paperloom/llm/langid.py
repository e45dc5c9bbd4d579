"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperloom.llm.common import slices, travels

travels(__name__)

#: Units of each direction; gates are clipped lines and the candidate state a softsign, so a step needs no exponentials.
UNITS = 8
#: A text is read in windows of CORE bytes. Each direction starts EDGE bytes ahead of its window; beyond a text's ends are zeros.
CORE, EDGE = 96, 16
#: Windows that are worked on together.
WINDOWS = 4096
#: The bound of the training sample: different texts of each language, and characters of each, from a place that its hash names.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 2000
#: Values of the hash that a text's place in the sample is drawn from.
HASHES = 1 << 40
#: Training: steps, windows a step, bytes of a window that are labelled.
STEPS, BATCH, TRAIN_CORE = 200, 128, 32
#: Documents scored lower are rejected by keep_known: no language stands out at all.
MIN_SCORE = 0.25
UNDETERMINED = "und"


def new_model(languages: list[str], seed: int = 0, dtype=np.float32) -> dict:
    """Weights by name. Index 0 of the first axis reads forwards, 1 backwards. The embedding is folded into the gates' tables."""
    rng = np.random.default_rng(seed)
    h, k = UNITS, len(languages)
    drawn = {
        "gate_in": rng.normal(0, 0.1, (2, 256, 2 * h)) + 0.5,  # update, then reset
        "gate_state": rng.normal(0, 0.2, (2, h, 2 * h)),
        "new_in": rng.normal(0, 0.5, (2, 256, h)),
        "new_state": rng.normal(0, 0.3, (2, h, h)),
        "out": rng.normal(0, 0.3, (2, h, k)),
        "bias": np.zeros(k),
    }
    return {"languages": languages, "weights": {n: w.astype(dtype) for n, w in drawn.items()}}


def run_direction(w: dict, d: int, x: np.ndarray, keep: int, trace: list | None = None) -> np.ndarray:
    """States after the last *keep* of the steps x (steps x windows of bytes, in reading order), and what training needs."""
    h_units = w["new_state"].shape[1]
    gate_in, gate_state, new_in, new_state = (w[n][d] for n in ("gate_in", "gate_state", "new_in", "new_state"))
    h = np.zeros((x.shape[1], h_units), new_in.dtype)
    states = np.empty((keep, *h.shape), h.dtype)
    skip = len(x) - keep
    for t, byte in enumerate(x):
        gates = gate_in.take(byte, 0)
        gates += h @ gate_state
        np.clip(gates, 0, 1, out=gates)
        z, r = gates[:, :h_units], gates[:, h_units:]
        inner = h @ new_state
        u = new_in.take(byte, 0)
        u += r * inner
        n = u / (1 + np.abs(u))
        if trace is not None:
            trace.append((byte, h, gates, inner, n))
        h = n + z * (h - n)
        if t >= skip:
            states[t - skip] = h
    return states


def probabilities(w: dict, x: np.ndarray, core: int, traces: list | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(core x windows x languages, states of both directions): the label probabilities of every position of the windows."""
    edge = (len(x) - core) // 2
    read = (x[: edge + core], x[::-1][: edge + core])
    states = []
    for d in (0, 1):
        if traces is not None:
            traces.append([])
        s = run_direction(w, d, read[d], core, traces[d] if traces is not None else None)
        states.append(s[::-1] if d else s)
    logits = states[0] @ w["out"][0] + states[1] @ w["out"][1] + w["bias"]
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits, states


def gradients(w: dict, x: np.ndarray, labels: np.ndarray, core: int) -> tuple[float, dict]:
    """(loss, gradient of every weight): mean cross entropy over all labelled positions, backwards through time."""
    traces: list = []
    p, states = probabilities(w, x, core, traces)
    count = core * x.shape[1]
    picked = p[:, np.arange(x.shape[1]), labels]
    loss = -float(np.log(np.maximum(picked, 1e-9)).mean())
    dlogits = p.copy()
    dlogits[:, np.arange(x.shape[1]), labels] -= 1
    dlogits /= count
    g = {n: np.zeros_like(v) for n, v in w.items()}
    g["bias"] = dlogits.sum((0, 1))
    h_units = w["new_state"].shape[1]
    for d in (0, 1):
        g["out"][d] = np.einsum("tbh,tbk->hk", states[d], dlogits)
        dstates = dlogits @ w["out"][d].T
        dstates = dstates[::-1] if d else dstates
        steps = traces[d]
        skip = len(steps) - core
        dh = np.zeros_like(steps[0][1])
        into_gates, into_new = [], []
        for t in range(len(steps) - 1, -1, -1):
            byte, h, gates, inner, n = steps[t]
            if t >= skip:
                dh = dh + dstates[t - skip]
            z, r = gates[:, :h_units], gates[:, h_units:]
            du = dh * (1 - z) * (1 - np.abs(n)) ** 2
            dgates = np.concatenate([dh * (h - n), du * inner], 1) * ((gates > 0) & (gates < 1))
            dinner = du * r
            g["gate_state"][d] += h.T @ dgates
            g["new_state"][d] += h.T @ dinner
            dh = dh * z + dinner @ w["new_state"][d].T + dgates @ w["gate_state"][d].T
            into_gates.append(dgates)
            into_new.append(du)
        bytes_read = np.concatenate([s[0] for s in reversed(steps)])
        np.add.at(g["gate_in"][d], bytes_read, np.concatenate(into_gates))
        np.add.at(g["new_in"][d], bytes_read, np.concatenate(into_new))
    return loss, g


def train(samples: list[tuple[str, bytes]], steps: int = STEPS, seed: int = 0) -> dict:
    """A model from (language, bytes) samples. Each step draws its windows evenly over languages; the result depends only on
    the samples, their order and the seed. Without samples the model knows no language."""
    languages = sorted({lang for lang, _ in samples})
    model = new_model(languages, seed)
    if len(languages) < 2:
        return model
    rng = np.random.default_rng(seed + 1)
    padded = [[np.frombuffer(b"\0" * EDGE + s + b"\0" * (EDGE + TRAIN_CORE), np.uint8) for lang, s in samples if lang == own] for own in languages]
    w = model["weights"]
    first, second = ({n: np.zeros_like(v) for n, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(languages), BATCH)
        windows = []
        for k in labels:
            text = padded[k][rng.integers(len(padded[k]))]
            at = rng.integers(max(1, len(text) - 2 * EDGE - 2 * TRAIN_CORE + 1))
            windows.append(text[at : at + 2 * EDGE + TRAIN_CORE])
        _, g = gradients(w, np.stack(windows, 1), labels, TRAIN_CORE)
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        rate = 0.03 * min(1, 1 / max(norm, 1e-9)) * (1 - 0.9 * step / steps)
        for n, v in g.items():
            first[n] += 0.1 * (v - first[n])
            second[n] += 0.01 * (v**2 - second[n])
            w[n] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-6)
    return model


def pooled(model: dict, texts: list[bytes]) -> np.ndarray:
    """(texts x languages): the mean over all bytes of a text of their label probabilities; zeros for an empty text."""
    w, languages = model["weights"], len(model["languages"])
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // CORE)
    room = counts * CORE + 2 * EDGE
    offsets = np.concatenate([[0], np.cumsum(room)])[:-1]
    buffer = np.zeros(int(room.sum()), np.uint8)
    for t, o in zip(texts, offsets.tolist(), strict=True):
        buffer[o + EDGE : o + EDGE + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[owner] + number * CORE
    sums = np.zeros((len(texts), languages))
    steps = np.arange(CORE + 2 * EDGE)[:, None]
    for a in range(0, len(starts), WINDOWS):
        own = owner[a : a + WINDOWS]
        p, _ = probabilities(w, buffer[starts[a : a + WINDOWS] + steps], CORE)
        left = sizes[own] - number[a : a + WINDOWS] * CORE
        short = left < CORE  # the last window of a text ends with it
        p[:, short] *= (np.arange(CORE)[:, None] < left[short])[:, :, None]
        np.add.at(sums, own, p.sum(0))
    return sums / np.maximum(sizes, 1)[:, None]


def fold(doc_id: Column) -> Column:
    """The remainder that says whether a document is held out (1) or may be learned from. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def training_sample(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> list[tuple[str, bytes]]:
    """At most SAMPLE_DOCS different texts of each language, those with the smallest hashes, and of each at most SAMPLE_CHARS
    characters from where the hash points. Held-out documents, null languages and null texts are not in it.

    Different texts are counted first (one number a language, as the sample itself holds texts of each), so that those beyond about
    twice the sample are dropped where they are read: no task receives more, however large the table.
    """
    known = docs.where((fold(F.col(id_col)) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    hashed = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).collect()
    if not sizes:
        return []
    limits = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, int(min(1.0, 2 * SAMPLE_DOCS / max(r.texts, 1)) * HASHES))])
    place = F.pmod("h", F.lit(HASHES))
    start = F.pmod("h", F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))) + 1
    piece = F.substring(F.col("text"), start.cast("int"), F.lit(SAMPLE_CHARS))
    likely = hashed.where(place < F.try_element_at(limits, F.col("lang"))).select("lang", "h", place.alias("place"), piece.alias("piece"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "h"))
    cut = likely.dropDuplicates(["lang", "h"]).withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS)
    return [(r.lang, r.piece.encode()) for r in sorted(cut.collect(), key=lambda r: (r.lang, r.rank))]


def learn(docs: DataFrame) -> dict:
    return train(training_sample(docs))


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, over whole texts.

    score: the pooled probability of lang_pred, the language with the highest one (the first by name on a tie). A null text, one
    without a letter, and any text under a model that knows no language, get `und` and score 0. Columns of these names in the input
    are replaced, all others passed on, and repeated rows answered alike. Only the text is read for the prediction.
    """
    rest = docs.drop("lang_pred", "score")
    given = rest.columns
    names = model["languages"]
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            readable = np.array(batch.column("_letter").to_pylist(), bool)
            texts = [t.encode() if ok else b"" for t, ok in zip(batch.column(text_col).to_pylist(), readable, strict=True)]
            labels, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if names:
                p = pooled(shared.value, texts)
                best = p.argmax(1)
                scores = np.where(readable, np.clip(p[np.arange(len(p)), best], 0, 1), 0)
                labels = [names[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), readable, strict=True)]
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "_letter"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*given, "lang_pred", "score"])

    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rest.withColumn("_letter", letter).mapInArrow(run, schema)


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents whose language is told: not those without a letter or scored below MIN_SCORE. Columns as given."""
    return predict(docs, learn(docs)).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def op8(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    told = predict(docs.select("doc_id", "text"), learn(docs))
    return told.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_byte_bigru": op8}
SQL: dict[str, str] = {}
