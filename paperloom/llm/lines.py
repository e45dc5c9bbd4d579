"""Line deduplication by a join of deletion neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import WORD, settle

#: Lines of fewer words are left alone.
MIN_WORDS = 3
#: Two lines are near if one word is added, dropped or replaced, and the longer has this many words.
NEAR_WORDS = 5
#: Sums of word hashes are kept below 2**31, so that products stay within a long.
PRIME = 2**31 - 1


def _words(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"({WORD})"), F.lit(1))


def one_spaced(line: Column) -> Column:
    """A line's words with one space between them. Most lines are that already, which plain searches tell without a pattern."""
    odd = line.startswith(" ") | line.endswith(" ")
    for mark in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | line.contains(mark)
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, line_no, n, k1, k2, halves) for every line of MIN_WORDS words or more, numbered from 0.

    A line is its words: white space does not count. k1 and k2 identify it. halves: for a partner of as many words and for
    one of a word more or less, hashes of the first and second half; near lines share at least one of them.
    """

    def halves(least: str) -> list[Column]:
        head = f"cast(floor({least} / 2) as int)"
        return [
            F.xxhash64(F.lit(1), F.expr(least), F.expr(f"substring_index(line, ' ', {head})")),
            F.xxhash64(F.lit(2), F.expr(least), F.expr(f"substring_index(line, ' ', {head} - {least})")),
        ]

    near = F.when(F.col("n") >= NEAR_WORDS - 1, F.array(*halves("n"), *halves("(n - 1)")))
    spaces = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
    return (
        docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .withColumn("line", one_spaced(F.col("line")))
        .withColumn("n", spaces + 1)
        .where(F.col("n") >= MIN_WORDS)
        .select("doc_id", "tkey", "line_no", "n", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(3), "line").alias("k2"), near.alias("halves"))
    )


def variants(lines: DataFrame) -> DataFrame:
    """n, i, left_out and whole beside the columns of the lines: for each word i, the key of the line without it, and of all of it.

    A key is a sum over words of hash times a number drawn from the position, modulo a prime, twice over (62 bits). Without
    word i, the words after it count with the position before theirs; running sums give all keys of a line in one pass.
    """
    own = [F.col(c) for c in lines.columns if c != "words"]
    spread = lines.select(*own, F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    line = Window.partitionBy("k1", "k2").orderBy("i")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("k1", "k2")

    def residue(*of) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(PRIME))

    for f in (1, 2):
        word, place, ahead = residue(F.lit(f), "word"), residue(F.lit(f + 2), "i"), residue(F.lit(f + 2), F.col("i") - 1)
        spread = spread.withColumn(f"own{f}", word * place % PRIME).withColumn(f"moved{f}", word * ahead % PRIME)

    def key(first: Column, second: Column) -> Column:
        return first % PRIME * (PRIME + 1) + second % PRIME

    without = [
        F.coalesce(F.sum(f"own{f}").over(before), F.lit(0)) + F.sum(f"moved{f}").over(every) - F.sum(f"moved{f}").over(upto)
        for f in (1, 2)
    ]
    whole = [F.sum(f"own{f}").over(every) for f in (1, 2)]
    return spread.select(*own, "n", "i", key(*without).alias("left_out"), key(*whole).alias("whole"))


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by one word added, dropped or replaced, or not at all."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.coalesce(F.array_position(same, False), F.lit(0)).cast("int")  # the first word that differs
    size = F.greatest(F.size(a), F.size(b))

    def rest(words: Column, start: Column) -> Column:
        return F.slice(words, F.greatest(start, F.lit(1)), size)

    return (
        (first == 0)
        | (rest(a, first + 1) == rest(b, first + 1))
        | ((F.size(a) < F.size(b)) & (rest(a, first) == rest(b, first + 1)))
        | ((F.size(a) > F.size(b)) & (rest(a, first + 1) == rest(b, first)))
    )


def near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(k1, k2, witness): lines with an earlier line within one word, and where that one first stands.

    firsts: (k1, k2, n, at, halves), one row per different line, at being where it first stands. Only lines that share
    a half with another emit their variants. Lines of equal length that agree without the word at one place, and lines that equal
    another without one of its words, meet under one hashed key; each key keeps its earliest line, so a key that very many
    lines share costs a minimum and no pairs. Every hit is then verified against the words.
    """
    halves = firsts.where("halves is not null").select("k1", "n", F.posexplode("halves").alias("which", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    # Where a first half is shared the words differ behind it, where a second half is, ahead of it: variants from there only.
    least = F.col("n") - F.floor(F.col("which") / 2)
    head = F.floor(least / 2)
    behind, ahead = F.when(F.col("which") % 2 == 0, head), F.when(F.col("which") % 2 == 1, F.col("n") - least + head)
    likely = halves.join(shared, "half").groupBy("k1").agg(F.min(behind).alias("behind"), F.max(ahead).alias("ahead"))
    wanted = (
        firsts.join(likely, "k1")
        .groupBy(F.col("at.doc_id").alias("d"), F.col("at.tkey").alias("t"))
        .agg(F.collect_list(F.struct("k1", "k2", "at", "behind", "ahead")).alias("wanted"))  # lines of one document
    )
    texts = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    found = (
        texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")))
        .withColumn("lines", F.split("text", "\n"))
        .select("lines", F.explode("wanted").alias("w"))
        .select("w.*", _words(F.get("lines", F.col("w.at.line_no"))).alias("words"))
    )
    lines = settle(found.dropDuplicates(["k1", "k2"]))
    may_differ = (F.col("i") >= F.col("behind")) | (F.col("i") < F.col("ahead"))
    spread = settle(variants(lines).withColumn("emits", F.coalesce(may_differ, F.lit(False))).where("i = 0 or emits"))
    whole = spread.where("i = 0").select("k1", "k2", "at", F.col("n").alias("m"), "whole")
    long = spread.where((F.col("n") >= NEAR_WORDS) & F.col("emits")).select("k1", "k2", "at", "n", "i", "left_out")
    earliest = F.min("at").alias("witness")

    replaced = long.groupBy("n", "i", "left_out").agg(earliest, F.count("*").alias("c")).where("c > 1").drop("c")
    by_replacing = long.join(replaced, ["n", "i", "left_out"])
    longest = long.groupBy((F.col("n") - 1).alias("m"), F.col("left_out").alias("whole")).agg(earliest)
    by_adding = whole.join(longest, ["m", "whole"])
    shorter = whole.select(F.col("m").alias("m"), F.col("whole").alias("left_out"), F.col("at").alias("witness"))
    by_dropping = long.withColumn("m", F.col("n") - 1).join(shorter, ["m", "left_out"])
    hits = [x.where("witness < at").select("k1", "k2", "witness") for x in (by_replacing, by_adding, by_dropping)]
    hit = hits[0].unionByName(hits[1]).unionByName(hits[2]).distinct()

    own = lines.select("k1", "k2", "words")
    other = lines.select(F.col("at").alias("witness"), F.col("words").alias("others"))
    checked = hit.join(own, ["k1", "k2"]).join(other, "witness").where(within_one(F.col("words"), F.col("others")))
    return checked.groupBy("k1", "k2").agg(F.min("witness").alias("witness"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, line_no, edits, witness): every line that an earlier line makes superfluous.

    Lines stand in the order of id (null first), text hash and number in the text. A line goes if an earlier one has the same words
    (edits 0) or one within a word of it (edits 1, from NEAR_WORDS words on), whether or not that one goes itself.
    """
    lines = settle(line_table(docs))
    place = F.struct("doc_id", "tkey", "line_no")
    firsts = settle(
        lines.groupBy("k1", "k2").agg(
            F.min(place).alias("at"), F.count("*").alias("c"), F.max("n").alias("n"), F.max("halves").alias("halves")
        )
    )
    near = near_lines(docs, firsts)
    again = firsts.where("c > 1").select("k1", "k2", F.col("at").alias("first"))
    doomed = again.join(near, ["k1", "k2"], "full")
    return (
        lines.join(doomed, ["k1", "k2"])
        .withColumn("at", F.struct("doc_id", "tkey", "line_no"))
        .where("witness is not null or first < at")
        .select(
            "doc_id",
            "tkey",
            "line_no",
            F.when(F.col("first") < F.col("at"), 0).otherwise(1).alias("edits"),
            F.when(F.col("first") < F.col("at"), F.col("first")).otherwise(F.col("witness")).alias("witness"),
        )
        .distinct()
    )


def _per_document(dropped: DataFrame) -> DataFrame:
    """One row per document that loses a line; the gathered numbers are lines of one document."""
    return dropped.groupBy(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t")).agg(
        F.sort_array(F.collect_list("line_no")).alias("_dropped"), F.sum(1 - F.col("edits")).alias("_exact"), F.sum("edits").alias("_near")
    )


def dedup_lines(docs: DataFrame, length_col: str | None = None) -> DataFrame:
    """Documents without their superfluous lines, columns as given; a document that loses all of its words goes.

    Null and empty texts, and texts without a word, stay as they are. Rows with the same id and text count as one document and
    are treated alike. Lines of fewer than MIN_WORDS words stay. Columns other than doc_id and text are passed on; length_col, if
    there is one of that name, is set to the characters of a text that has lost lines.
    """
    gone = _per_document(dropped_lines(docs.select("doc_id", "text")))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left")
    untouched = F.col("_dropped").isNull()
    split = joined.withColumn("_lines", F.when(~untouched, F.split("text", "\n")))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    rest = F.array_join(F.transform(numbers, lambda i: F.get(F.col("_lines"), i)), "\n")
    text = F.when(untouched, F.col("text")).otherwise(rest)

    def given(name: str) -> Column:
        if name == "text":
            return F.col("_text")
        if name == length_col:
            return F.when(untouched, F.col(name)).otherwise(F.length("_text").cast(docs.schema[name].dataType))
        return F.col(name)

    return (
        split.withColumn("_text", text)
        .where(untouched | F.col("_text").rlike(WORD))
        .select(*[given(c).alias(c) for c in docs.columns])
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_exact, n_near, dropped) per row: how many lines go and which, numbered from 0.

    A null text has no lines; an empty one has one. Rows with the same id and text get the same answer.
    """
    thin = docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n"))
    gone = _per_document(dropped_lines(docs.select("doc_id", "text")))
    return thin.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tkey") == F.col("_t")), "left").select(
        "doc_id",
        F.when(F.col("n") > 0, F.col("n")).otherwise(0).cast("long").alias("n_lines"),
        F.coalesce("_exact", F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.array_join("_dropped", ","), F.lit("")).alias("dropped"),
    )


QUERIES = {"op9_deletion_lines": lambda spark, sf_dir: line_digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))}

#: Every line emits its variants here, as text and without a filter ahead.
SQL = {
    "op9_deletion_lines": """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS words FROM l),
f AS (
  SELECT words, len(words) AS n, min((doc_id, line_no)) AS pos FROM w WHERE len(words) >= 3 GROUP BY words),
v AS (
  SELECT words, n, pos, i, array_to_string(list_concat(words[:i - 1], words[i + 1:]), ' ') AS rest
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 4)),
s AS (SELECT n, i, rest, min(pos) AS pos FROM v WHERE n >= 5 GROUP BY ALL),
longer AS (SELECT rest, min(pos) AS pos FROM v WHERE n >= 5 GROUP BY ALL),
near AS (
  SELECT v.words FROM v JOIN s USING (n, i, rest) WHERE s.pos < v.pos
  UNION SELECT f.words FROM f JOIN longer ON array_to_string(f.words, ' ') = longer.rest WHERE longer.pos < f.pos
  UNION SELECT v.words FROM v JOIN f ON array_to_string(f.words, ' ') = v.rest WHERE v.n >= 5 AND f.pos < v.pos),
d AS (
  SELECT w.doc_id, w.line_no, CASE WHEN f.pos < (w.doc_id, w.line_no) THEN 0 ELSE 1 END AS edits
  FROM w JOIN f USING (words) LEFT JOIN near ON near.words = w.words
  WHERE near.words IS NOT NULL OR f.pos < (w.doc_id, w.line_no)),
g AS (
  SELECT doc_id, count(*) FILTER (edits = 0) AS n_exact, count(*) FILTER (edits = 1) AS n_near,
    string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS dropped FROM d GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact,
  coalesce(n_near, 0)::BIGINT AS n_near, coalesce(dropped, '') AS dropped
FROM documents LEFT JOIN g USING (doc_id)
"""
}
