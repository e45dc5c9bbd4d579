"""Secret scans: rules first, then a character convolutional network over every other candidate and what stands around it."""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import forget, settle, slices, travels
from paperloom.llm.middle import points

travels(__name__)

#: The base rules in the order of their kinds. Bytes, so that "either case" means ASCII letters only.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "learned")
LEAST_VALUE = 8
#: A text without any of these, in lower case, holds no match of ASSIGN.
WORDS_OF_ASSIGN = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Candidates: whole runs, without marks at their ends, that hold a digit or turn from lower to upper case.
LEAST_CANDIDATE = 16
RUN = re.compile(rb"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}={0,2}")
MARKS = b"+/_.-"
MIXED = re.compile(rb"[0-9]|[a-z][A-Z]")
#: What in the bytes ahead speaks of a secret; such candidates have a threshold of their own.
HINT = re.compile(rb"pass|pwd|secret|token|key|auth|bearer|credential", re.I)
#: Bytes of context on either side.
CONTEXT = 24
#: The network: size of a byte's vector, width and number of filters, hidden units.
VECTOR, WIDTH, FILTERS, HIDDEN = 8, 5, 24, 16
#: Positions of one row of work, and rows worked on together. A candidate has as many rows as it needs.
ROW, ROWS = 64, 2048
#: The bound of findings(): different findings by the rules, different other candidates, bytes of each. The query does not use it.
MOST_FINDINGS, MOST_OTHERS, SAMPLE_BYTES = 2000, 4000, 96
#: All different candidates are dealt to shards of about so many pieces of SAMPLE_BYTES; so many tasks work on them at most.
SHARD, TASKS = 1 << 14, 2000
#: Training of a shard: examples made up beside its own (so many of each label, or a quarter of its own if more), least steps,
#: examples a step, and how often the weights of all shards are averaged.
MADE, STEPS, BATCH, ROUNDS = 1500, 400, 64, 4
#: Weights are averaged in steps of 1 / FINE, so that the order of the shards changes nothing; scores have CELLS steps to 1.
FINE, CELLS, MOST_SCORE = 1 << 30, 256, 32
#: Share of the secrets that the thresholds without and with a hint must keep, on the third of the examples not learned from.
RECALL = (0.95, 0.98)
SEGMENTS = (1, 2, 3)  # left, inside, right


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) in bytes of what the base rules find in a text, by start, then kind."""
    found = []
    lower = raw.lower()
    if any(w in lower for w in WORDS_OF_ASSIGN):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if len(m.group(2)) >= LEAST_VALUE]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    return sorted(found)


def candidates(raw: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, whether a base span overlaps it) in bytes of every candidate, in order."""
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    found = []
    for m in RUN.finditer(raw):
        run = m.group()
        start = m.start() + len(run) - len(run.lstrip(MARKS))
        end = m.start() + len(run.rstrip(MARKS))
        if end - start >= LEAST_CANDIDATE and MIXED.search(raw, start, end):
            ahead = bisect_left(starts, end)
            found.append((start, end, bool(ahead) and reach[ahead - 1] > start))
    return found


def places(raw: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points ahead of each byte offset."""
    told, last, count = {}, 0, 0
    for at in sorted(set(offsets)):
        count += points(raw[last:at])
        told[at], last = count, at
    return told


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
CANDIDATE = pa.struct(
    [("start", pa.int64()), ("end", pa.int64()), ("before", pa.binary()), ("inside", pa.binary()), ("after", pa.binary()), ("found", pa.bool_())]
)


def gather(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, others, held) per row: base spans and candidates of a whole text in code points, the latter with their bytes and
    the CONTEXT bytes on either side; held counts those bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            base, others, held = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                raw = text or b""
                spans = base_spans(raw)
                found = candidates(raw, spans)
                at = places(raw, [x for s, _, e in spans for x in (s, e)] + [x for s, e, _ in found for x in (s, e)])
                base.append([{"kind": k, "start": at[s], "end": at[e]} for s, k, e in spans])
                others.append([
                    {"start": at[s], "end": at[e], "before": raw[max(s - CONTEXT, 0) : s], "inside": raw[s:e], "after": raw[e : e + CONTEXT], "found": f}
                    for s, e, f in found
                ])
                held.append(sum(e - s + 100 for s, e, _ in found))
            arrays = [pa.array(base, pa.list_(SPAN)), pa.array(others, pa.list_(CANDIDATE)), pa.array(held, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", "base", "others", "held"])

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = thin.schema["id"].dataType.simpleString()
    candidate = "struct<start: long, end: long, before: binary, inside: binary, after: binary, found: boolean>"
    return thin.mapInArrow(run, f"id {kind}, base array<struct<kind: int, start: long, end: long>>, others array<{candidate}>, held long")


def findings(gathered: DataFrame, most_findings: int = MOST_FINDINGS, most_others: int = MOST_OTHERS) -> list[tuple[bytes, bytes, bytes, int]]:
    """A sample of (before, inside, after, label) of different candidates: label 1 where a base rule finds it, else 0.

    For a look at a table or a model of one machine; learn() takes every candidate. Those of the smallest hashes, at most so many of each label. Different ones are counted first, so that rows beyond about twice the
    sample are dropped where they are read and no task receives more.
    """
    one = gathered.select(F.explode("others").alias("c")).select(
        "c.before", F.substring("c.inside", 1, SAMPLE_BYTES).alias("inside"), "c.after", F.col("c.found").cast("int").alias("label")
    )
    keyed = one.withColumn("key", F.xxhash64("before", "inside", "after", "label"))
    sizes = {r.label: r.n for r in keyed.groupBy("label").agg(F.approx_count_distinct("key").alias("n")).collect()}
    sample = []
    for label, most in ((0, most_others), (1, most_findings)):
        share = min(1.0, 2 * most / max(sizes.get(label, 0), 1))
        likely = keyed.where((F.col("label") == label) & (F.pmod("key", F.lit(1 << 30)) < math.ceil(share * (1 << 30))))
        rows = likely.dropDuplicates(["key"]).orderBy(F.pmod("key", F.lit(1 << 30)), "key").limit(most).collect()
        sample += [(bytes(r.before), bytes(r.inside), bytes(r.after), label) for r in rows]
    return sorted(sample)


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CONSONANTS = "bcdfghjklmnprstvwz"
#: Shapes of made-up secrets (first characters, alphabet, least and most length) and what may lead up to one.
SHAPES = (
    ("", LOWER + UPPER + DIGITS, 20, 64),
    ("", LOWER + UPPER + DIGITS + "+/", 24, 88),
    ("", LOWER + DIGITS, 24, 48),
    ("", "0123456789abcdef", 24, 31),
    ("", "0123456789ABCDEF", 24, 64),
    ("", UPPER + DIGITS, 20, 40),
    ("ghp_", LOWER + UPPER + DIGITS, 32, 40),
    ("sk_live_", LOWER + UPPER + DIGITS, 20, 40),
    ("xoxb-", DIGITS + "-" + LOWER + UPPER, 30, 60),
    ("eyJ", LOWER + UPPER + DIGITS + "-_.", 60, 150),
)
LEADS = ("", "", "", "api_key = ", "secret: ", "Authorization: Bearer ", "PASSWORD=", "access_key: ", "pwd is ", "token ")


def made_up(contexts: list[tuple[bytes, bytes]], count: int, seed: int = 0) -> list[tuple[bytes, bytes, bytes, int]]:
    """*count* secrets of SHAPES and as many things that only look long, in contexts of the corpus or of made-up words."""
    rng = random.Random(seed)

    def some(alphabet: str, least: int, most: int) -> str:
        return "".join(rng.choices(alphabet, k=rng.randint(least, most)))

    def word() -> str:  # can be spoken, as words can
        return "".join(some(CONSONANTS, 1, 1) + some("aeiouy", 1, 1) + some("nrstl", 0, 1) for _ in range(rng.randint(1, 4)))

    def words(n: int, between: str) -> str:
        return between.join(word() for _ in range(n))

    def digits(least: int, most: int) -> str:
        return some(DIGITS, least, most)

    harmless = (
        lambda: digits(16, 22),
        lambda: words(3, ".") + "." + digits(2, 4),
        lambda: words(3, "/") + "/" + digits(2, 4) + "/" + word() + ".html",
        lambda: words(4, "-") + "-" + digits(2, 4),
        lambda: words(4, "_") + digits(2, 4),
        lambda: "".join(word().capitalize() for _ in range(4)),
        lambda: word() + "".join(word().capitalize() for _ in range(3)),
        lambda: "-".join(some("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12)),
        lambda: f"20{digits(2, 2)}-{digits(2, 2)}-{digits(2, 2)}T{digits(6, 6)}",
        lambda: f"v{digits(1, 2)}.{digits(1, 2)}.{digits(1, 2)}-{word()}.{digits(2, 4)}",
    )
    examples = []
    for label in (0, 1):
        for _ in range(count):
            if contexts and rng.random() < 0.7:
                before, after = rng.choice(contexts)
            else:
                before, after = words(4, " ").encode() + b" ", b" " + words(4, " ").encode()
            if label:
                first, alphabet, least, most = rng.choice(SHAPES)
                inside = first + some(alphabet, least, most)
                before += rng.choice(LEADS).encode()
            else:
                inside = rng.choice(harmless)()
                while len(inside) < LEAST_CANDIDATE:
                    inside += word()
            examples.append((before[-CONTEXT:], inside.encode(), after[:CONTEXT], label))
    return examples


def new_weights(seed: int = 0, dtype=np.float32) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    drawn = {
        "vector": rng.normal(0, 0.5, (256, VECTOR)),
        "filter": rng.normal(0, 0.2, (WIDTH, VECTOR, FILTERS)),
        "filter_bias": np.zeros(FILTERS),
        "hidden": rng.normal(0, 0.15, (4 * FILTERS + 1, HIDDEN)),
        "hidden_bias": np.zeros(HIDDEN),
        "out": rng.normal(0, 0.3, HIDDEN),
        "bias": np.zeros(1),
    }
    return {n: v.astype(dtype) for n, v in drawn.items()}


def activations(w: dict, x: np.ndarray) -> np.ndarray:
    """(rows x positions x filters): the filters at every position of rows of bytes that have WIDTH - 1 more than positions."""
    tables = w["vector"] @ w["filter"]
    size = x.shape[1] - WIDTH + 1
    total = w["filter_bias"] + tables[0].take(x[:, :size], 0)
    for k in range(1, WIDTH):
        total += tables[k].take(x[:, k : k + size], 0)
    return np.maximum(total, 0, out=total)


def head(w: dict, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0)
    return hidden @ w["out"] + w["bias"], hidden


def _laid_out(example: tuple, room: int, pad: int) -> tuple[bytes, bytes]:
    """A candidate's bytes between padded contexts, and the segment of each position, both cut or filled to *room*."""
    before, inside, after = example[:3]
    raw = before.rjust(CONTEXT, b"\0") + inside + after.ljust(CONTEXT, b"\0")
    part = b"\1" * CONTEXT + b"\2" * len(inside) + b"\3" * CONTEXT
    return b"\0" * pad + raw.ljust(room, b"\0") + b"\0" * pad, part.ljust(room, b"\0")


def logits(w: dict, examples: list[tuple]) -> np.ndarray:
    """One number per (before, inside, after): highest filter answers to the left, inside and to the right, the mean inside and the
    length, through the hidden units. A candidate of any length is worked on row by row."""
    pad = WIDTH // 2
    sizes = np.array([len(e[1]) + 2 * CONTEXT for e in examples], np.int64)
    counts = -(-sizes // ROW)
    laid = [_laid_out(e, int(c) * ROW, pad) for e, c in zip(examples, counts, strict=True)]
    x = np.frombuffer(b"".join(a for a, _ in laid), np.uint8)
    part = np.frombuffer(b"".join(b for _, b in laid), np.uint8).reshape(-1, ROW)
    owner = np.repeat(np.arange(len(examples)), counts)
    starts = np.arange(len(owner)) * ROW + owner * 2 * pad
    pooled = np.zeros((len(examples), 4, FILTERS), np.float32)
    for a in range(0, len(owner), ROWS):
        own, parts = owner[a : a + ROWS], part[a : a + ROWS]
        act = activations(w, x[starts[a : a + ROWS, None] + np.arange(ROW + 2 * pad)])
        for s in SEGMENTS:
            inside = act * (parts == s)[:, :, None]
            np.maximum.at(pooled[:, s - 1], own, inside.max(1))
            if s == 2:
                np.add.at(pooled[:, 3], own, inside.sum(1))
    lengths = np.maximum(sizes - 2 * CONTEXT, 1)
    pooled[:, 3] /= lengths[:, None]
    return head(w, np.concatenate([pooled.reshape(len(examples), -1), np.log2(lengths)[:, None].astype(np.float32) / 8], 1))[0]


def laid_rows(examples: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Examples of at most SAMPLE_BYTES as one row each: bytes, segments, lengths."""
    room = SAMPLE_BYTES + 2 * CONTEXT
    cut = [(b, i[:SAMPLE_BYTES], a) for b, i, a, *_ in examples]
    laid = [_laid_out(e, room, WIDTH // 2) for e in cut]
    x = np.frombuffer(b"".join(a for a, _ in laid), np.uint8).reshape(len(cut), -1)
    part = np.frombuffer(b"".join(b for _, b in laid), np.uint8).reshape(len(cut), room)
    return x, part, np.array([max(len(e[1]), 1) for e in cut])


def gradients(w: dict, x: np.ndarray, part: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """(loss, gradient of every weight): mean cross entropy; a maximum passes its gradient to where it stands."""
    act = activations(w, x)
    n, size, _ = act.shape
    masked = [act * (part == s)[:, :, None] for s in SEGMENTS]
    best = [m.argmax(1) for m in masked]
    pooled = np.concatenate(
        [*(m.max(1) for m in masked), masked[1].sum(1) / lengths[:, None], (np.log2(lengths) / 8)[:, None]], 1
    ).astype(act.dtype)
    z, hidden = head(w, pooled)
    p = 1 / (1 + np.exp(-z))
    loss = float(np.mean(np.logaddexp(0, z) - labels * z))
    dz = ((p - labels) / n).astype(act.dtype)
    g = {"bias": dz.sum(keepdims=True), "out": hidden.T @ dz}
    dhidden = np.outer(dz, w["out"]) * (hidden > 0)
    g["hidden"], g["hidden_bias"] = pooled.T @ dhidden, dhidden.sum(0)
    dpooled = dhidden @ w["hidden"].T
    dact = np.zeros_like(act)
    rows, filters = np.arange(n)[:, None], np.arange(FILTERS)[None]
    for s, at in zip(SEGMENTS, best, strict=True):
        dact[rows, at, filters] += dpooled[:, (s - 1) * FILTERS : s * FILTERS] * (part[rows, at] == s)
    dact += (dpooled[:, 3 * FILTERS : 4 * FILTERS] / lengths[:, None])[:, None] * (part == 2)[:, :, None]
    dact *= act > 0
    g["filter_bias"] = dact.sum((0, 1))
    g["vector"], g["filter"] = np.zeros_like(w["vector"]), np.zeros_like(w["filter"])
    flat = dact.reshape(-1, FILTERS)
    for k in range(WIDTH):
        read = x[:, k : k + size].reshape(-1)
        by_byte = np.stack([np.bincount(read, flat[:, f], 256) for f in range(FILTERS)], 1)
        g["filter"][k] = w["vector"].T @ by_byte
        g["vector"] += by_byte @ w["filter"][k].T
    return loss, g


def calibration(z: np.ndarray, labels: np.ndarray, counts: np.ndarray | int = 1) -> tuple[float, float]:
    """(slope, shift) that make logistic(slope * z + shift) a probability, by Newton steps on the cross entropy with a slight pull to 1, 0.

    Each z stands for as many examples as *counts* says.
    """
    at = np.array([1.0, 0.0])
    x = np.stack([z.astype(float), np.ones(len(z))], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (counts * (p - labels)) + 1e-2 * (at - [1.0, 0.0])
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        at = at - np.linalg.solve(bend, slope)
    return float(at[0]), float(at[1])


def threshold(p: np.ndarray, recall: float, counts: np.ndarray | None = None) -> float:
    """The highest limit that *recall* of these secrets' probabilities reach; none is reached where there are no secrets."""
    if not len(p):
        return math.inf
    falling = np.argsort(-p, kind="stable")
    reached = np.cumsum(np.ones(len(p), np.int64) if counts is None else counts[falling])
    return float(p[falling][np.searchsorted(reached, math.ceil(recall * int(reached[-1])))])


def is_hinted(example: tuple) -> bool:
    return HINT.search(example[0]) is not None


def pieces(example: tuple) -> list[tuple]:
    """A candidate's bytes in pieces of at most SAMPLE_BYTES, about equal, each between the candidate's own contexts."""
    before, inside, after, label = example
    size = -(-len(inside) // -(-len(inside) // SAMPLE_BYTES))
    return [(before, inside[at : at + size], after, label) for at in range(0, len(inside), size)]


def examples_of(sample: list[tuple[bytes, bytes, bytes, int]], made: int, shard: int, seed: int) -> tuple[list[tuple], list[tuple]]:
    """(examples learned from, examples kept for calibration and thresholds) of one shard: every third one is kept, whole.

    Beside its candidates a shard has made-up examples, and findings of the rules also in contexts of other candidates, so that the
    rules' own words do not decide alone.
    """
    rng = np.random.default_rng([seed, shard])
    sample = sorted(sample)
    contexts = [(b, a) for b, _, a, label in sample if not label]
    moved = [(*contexts[rng.integers(len(contexts))], i) for _, i, _, label in sample if label and contexts]
    examples = [*sample, *((b, i, a, 1) for b, a, i in moved), *made_up(contexts, max(made, len(sample) // 4), seed + shard)]
    return [p for k, e in enumerate(examples) if k % 3 != 2 for p in pieces(e)], examples[2::3]


def schedule(labels: np.ndarray, steps: int, rng: np.random.Generator) -> np.ndarray:
    """(steps x BATCH) places of the examples of every step, half of each label; no place is left out, as many steps as that takes."""
    half = BATCH // 2
    orders = [rng.permutation(np.flatnonzero(labels == label)) for label in (0, 1)]
    steps = max(steps, *(-(-len(o) // half) for o in orders))
    steps = -(-steps // ROUNDS) * ROUNDS
    return np.concatenate([o.take(np.arange(steps * half), mode="wrap").reshape(steps, half) for o in orders], 1)


def improved(w: dict, learned: list[tuple], turn: int, steps: int, shard: int, seed: int) -> dict:
    """The weights after round *turn* of ROUNDS over a shard's examples; the rounds together see every one."""
    w = {n: v.copy() for n, v in w.items()}
    x, part, lengths = laid_rows(learned)
    labels = np.array([e[3] for e in learned])
    plan = schedule(labels, steps, np.random.default_rng([seed, shard, 1]))
    each = len(plan) // ROUNDS
    first, second = ({n: np.zeros_like(v) for n, v in w.items()} for _ in range(2))
    for step in range(1, each + 1):
        done = turn * each + step
        at = plan[done - 1]
        _, g = gradients(w, x[at], part[at], lengths[at], labels[at])
        rate = 0.01 * (1 - 0.9 * done / len(plan))
        for n, v in g.items():
            first[n] += 0.1 * (v - first[n])
            second[n] += 0.01 * (v**2 - second[n])
            w[n] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-6)
    return w


def as_numbers(w: dict) -> np.ndarray:
    return np.rint(np.concatenate([v.ravel() for v in w.values()]).astype(float) * FINE).astype(np.int64)


def as_weights(sums: np.ndarray, shards: int) -> dict:
    """The mean of the weights of so many shards."""
    like = new_weights()
    cuts = np.cumsum([v.size for v in like.values()])[:-1]
    return {n: (p / shards / FINE).reshape(v.shape).astype(v.dtype) for (n, v), p in zip(like.items(), np.split(sums, cuts), strict=True)}


def rounded(z: np.ndarray) -> np.ndarray:
    """Scores in whole cells, which can be counted exactly."""
    return np.rint(np.clip(z, -MOST_SCORE, MOST_SCORE) * CELLS).astype(np.int64)


def probability(cells: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return np.round(1 / (1 + np.exp(-np.clip(slope * (cells / CELLS) + shift, -30, 30))), 12)


def cells_of(w: dict, kept: list[tuple]) -> dict[tuple[int, int, int], int]:
    """How many of these examples have each (cell, label, hint)."""
    keys = zip(rounded(logits(w, kept)).tolist(), (e[3] for e in kept), (int(is_hinted(e)) for e in kept), strict=True)
    return dict(Counter(keys))


def concluded(w: dict, cells: dict[tuple[int, int, int], int]) -> dict:
    """The model: weights, calibration, and a threshold with and without a hint ahead, from the exact counts of all examples kept."""
    z, own, hinted = np.array(sorted(cells), np.int64).reshape(-1, 3).T
    n = np.array([cells[k] for k in sorted(cells)], np.int64)
    slope, shift = calibration(z / CELLS, own, n)
    p = probability(z, slope, shift)
    secrets = [(own == 1) & (hinted == h) for h in (0, 1)]
    return {"weights": w, "slope": slope, "shift": shift, "limits": [threshold(p[at], RECALL[h], n[at]) for h, at in enumerate(secrets)]}


def train(sample: list[tuple[bytes, bytes, bytes, int]], made: int = MADE, steps: int = STEPS, seed: int = 0) -> dict:
    """A model from labelled (before, inside, after, label): what learn() makes of a table whose candidates fill one shard.

    The result depends only on the sample and the seed.
    """
    learned, kept = examples_of(sample, made, 0, seed)
    w = new_weights(seed)
    for turn in range(ROUNDS):
        w = as_weights(as_numbers(improved(w, learned, turn, steps, 0, seed)), 1)
    return concluded(w, cells_of(w, kept))


def learn(gathered: DataFrame, made: int = MADE, steps: int = STEPS, seed: int = 0, shard: int = SHARD) -> dict:
    """A model from every different candidate of gather(), labelled by the rules.

    The candidates are dealt by their hash to shards, each of which learns from all of its own but every third; the weights of the
    shards are averaged ROUNDS times on the way. Calibration and thresholds come from the scores of every third candidate, counted
    exactly. Neither the partitions of the table nor its repeated candidates change the result.
    """
    one = gathered.select(F.explode("others").alias("c")).select("c.before", "c.inside", "c.after", F.col("c.found").cast("int").alias("label"))
    different = settle(one.distinct())
    total = different.agg(F.sum(F.ceil(F.length("inside") / SAMPLE_BYTES))).first()[0]
    if not total:
        forget(different)
        return train([], made, steps, seed)
    shards = -(-total // shard)
    number = F.pmod(F.xxhash64(*different.columns), F.lit(shards)).cast("int")
    dealt = different.withColumn("shard", number).repartitionById(min(shards, TASKS), "shard").groupBy("shard")

    def own(key: tuple, rows: pa.Table) -> tuple[int, list[tuple], list[tuple]]:
        at = key[0].as_py()
        sample = list(zip(*(rows.column(n).to_pylist() for n in ("before", "inside", "after", "label")), strict=True))
        return at, *examples_of(sample, made, at, seed)

    def round_of(w: dict, turn: int):
        def work(key: tuple, rows: pa.Table) -> pa.Table:
            at, learned, _ = own(key, rows)
            numbers = as_numbers(improved(w, learned, turn, steps, at, seed))
            return pa.table({"place": pa.array(range(len(numbers)), pa.int32()), "number": numbers})

        return dealt.applyInArrow(work, "place int, number long").groupBy("place").agg(F.sum("number").alias("sum"), F.count("*").alias("n"))

    w = new_weights(seed)
    for turn in range(ROUNDS):
        told = sorted(round_of(w, turn).collect())
        w = as_weights(np.array([r["sum"] for r in told]), told[0]["n"])

    def score(key: tuple, rows: pa.Table) -> pa.Table:
        found = cells_of(w, own(key, rows)[2])
        columns = [*zip(*found, strict=True)] if found else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in (*columns, list(found.values()))], ["cell", "label", "hint", "n"])

    scored = dealt.applyInArrow(score, "cell long, label long, hint long, n long").groupBy("cell", "label", "hint").agg(F.sum("n").alias("n")).collect()
    forget(different)
    return concluded(w, {(r["cell"], r["label"], r["hint"]): r["n"] for r in scored})


def judged(model: dict, examples: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(probability, whether it reaches its threshold) for (before, inside, after)."""
    if not examples:
        return np.zeros(0), np.zeros(0, bool)
    p = probability(rounded(logits(model["weights"], examples)), model["slope"], model["shift"])
    return p, p >= np.array(model["limits"])[[int(is_hinted(e)) for e in examples]]


def judge(gathered: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """(id, findings) per row of gather(): all spans by start, then kind; a learned one has its probability as score."""
    shared = gathered.sparkSession.sparkContext.broadcast(model)  # a few thousand weights
    finding = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "held", measure=lambda sizes: sizes):
            sizes = pc.list_value_length(batch.column("others")).to_pylist()
            flat = batch.column("others").flatten()
            columns = [pc.struct_field(flat, n).to_pylist() for n in ("before", "inside", "after", "start", "end", "found")]
            scores, reached = judged(shared.value, list(zip(*columns[:3], strict=True)))
            rows, at = [], 0
            for base, size in zip(batch.column("base").to_pylist(), sizes, strict=True):
                spans = [(s["start"], s["kind"], s["end"], None) for s in base]
                for i in range(at, at + size):
                    if reached[i] and not columns[5][i]:
                        spans.append((columns[3][i], 3, columns[4][i], float(scores[i])))
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in sorted(spans, key=lambda x: x[:3])])
                at += size
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(finding))], ["id", "findings"])

    kind = gathered.schema["id"].dataType.simpleString()
    schema = f"id {kind}, findings array<struct<kind: string, start: long, end: long, score: double>>"
    return gathered.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """(id, findings) per row: spans of the base rules and those the network adds, in code points, end exclusive.

    Without a model one is learned from all candidates of these documents, labelled by the rules, and from made-up examples. A candidate that a base span overlaps is never added. A null or empty text has no findings; rows equal in text are
    answered alike; other columns are not read. An empty table gives no rows.
    """
    gathered = settle(gather(docs, id_col, text_col))
    return judge(gathered, model or learn(gathered), id_col)


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13(spark, sf_dir):
    told = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = F.col("findings")

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    base = F.filter(found, lambda s: s["kind"] != KINDS[3])
    return told.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(found).alias("spans"))


QUERIES = {"op13_secret_cnn": op13}
SQL: dict[str, str] = {}
