"""Stored rules as one table of violations: (rule, table, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.functions import exam


def _checks() -> list[tuple[str, str, Column]]:
    c = F.col
    pending = c("status") == "pending"
    return [
        ("option number range", "options", c("option_number").between(1, exam.OPTIONS_PER_BOOK)),
        ("exam type", "options", c("exam_type").isin(*exam.EXAM_TYPES)),
        ("part", "questions", c("part").isin(*exam.PARTS)),
        ("question number", "questions", c("question_number") > 0),
        ("part A key", "questions", (c("part") != "A") | c("answer").isNull() | c("answer").rlike(exam.PART_A_KEY_PATTERN)),
        ("status", "students", c("status").isin(*exam.STATUSES)),
        ("decision recorded", "students", pending == c("handled_at").isNull()),
        ("decision after application", "students", pending | c("full_name").isNotNull()),
        ("completed after started", "test_sessions", c("completed_at").isNull() | (c("completed_at") >= c("started_at"))),
        ("time spent", "session_answers", c("time_spent_seconds") >= 0),
    ]


def _text(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("string") for c in columns])


def _claims(rows: DataFrame, table: str, present: set[str]) -> DataFrame | None:
    """(rule, table, key, _parent, _at): in one pass over a table, a row for every broken CHECK and one for every reference.

    What a reference names is _at in the table _parent; a broken rule names nothing. A comparison with null passes, as it does in SQL,
    and so does a null reference.
    """
    nothing = F.lit(None).cast("string")
    made = []
    for rule, of, holds in _checks():
        if of == table:
            made.append(F.when(~holds, F.struct(F.lit(rule).alias("rule"), nothing.alias("_parent"), nothing.alias("_at"))))
    for child, column, parent, _, _ in schemas.FOREIGN_KEYS:
        if child == table and parent in present:
            named = F.struct(F.lit(f"{column} refers to {parent}").alias("rule"), F.lit(parent).alias("_parent"), F.col(column).cast("string").alias("_at"))
            made.append(F.when(F.col(column).isNotNull(), named))
    if not made:
        return None
    key = F.array_join(_text(schemas.UNIQUE_KEYS[table][0]), "|")
    each = rows.select(key.alias("key"), F.explode(F.array_compact(F.array(*made))).alias("_c"))
    return each.select("_c.rule", F.lit(table).alias("table"), "key", "_c._parent", "_c._at")


def _key_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, primary, values, _n): how many rows hold each value of each unique key, all keys of a table in one pass."""
    parts = []
    for table, rows in tables.items():
        keys = [
            F.struct(F.lit("unique " + ", ".join(key)).alias("rule"), F.lit(i == 0).alias("primary"), _text(key).alias("values"))
            for i, key in enumerate(schemas.UNIQUE_KEYS[table])
        ]
        parts.append(rows.select(F.lit(table).alias("table"), F.explode(F.array(*keys)).alias("_k")).select("table", "_k.*"))
    return reduce(DataFrame.unionByName, parts).groupBy("table", "rule", "primary", "values").agg(F.count(F.lit(1)).alias("_n"))


def _held(counts: DataFrame, present: set[str]) -> DataFrame:
    """(_parent, _at, _here): the rows that a reference of these tables can name.

    The condition holds the count and the value is never null, so nothing is pushed below the grouping and every branch reads the
    same one. No reference is an empty text.
    """
    named = sorted({parent for child, _, parent, _, _ in schemas.FOREIGN_KEYS if child in present and parent in present})
    parents = counts.filter(F.when(F.col("primary") & F.col("table").isin(named), F.col("_n")).otherwise(0) > 0)
    return parents.select(F.col("table").alias("_parent"), F.coalesce(F.get("values", F.lit(0)), F.lit("")).alias("_at"), F.lit(True).alias("_here"))


def _all_claims(tables: dict[str, DataFrame]) -> DataFrame | None:
    made = [_claims(rows, table, set(tables)) for table, rows in tables.items()]
    claims = [c for c in made if c is not None]
    return reduce(DataFrame.unionByName, claims) if claims else None


def _unheld(claims: DataFrame, held: DataFrame) -> DataFrame:
    # Not an anti join: that would be pushed below the union, and the parents worked out once a table.
    return claims.join(held, ["_parent", "_at"], "left").filter("_here IS NULL")


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows a CHECK would refuse, values of a unique key that more than one row holds, and rows whose parent is missing.

    Every table is read twice: for its keys, counted in one grouping that also tells which parents there are, and for its claims.
    All claims are held against the parents in one join; a broken CHECK names no parent and always stays.
    """
    counts = _key_counts(tables)
    repeated = counts.filter("_n > 1").select("rule", "table", F.array_join("values", "|").alias("key"))
    claims = _all_claims(tables)
    if claims is None:
        return repeated
    return repeated.unionByName(_unheld(claims, _held(counts, set(tables))).select("rule", "table", "key"))


def violation_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("violations"))


def _whole(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint")


def _rule_count(counted: DataFrame, table: str, rule: str) -> DataFrame:
    """(table, rule, violations) of a single sum; no row where nothing breaks the rule."""
    return counted.filter("violations > 0").select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), "violations")


def counted_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """:func:`violation_counts` of :func:`violations`, without a row for each.

    Every rule is counted over its own columns in their own types: a table's CHECKs in one pass, a unique key in one grouping, a
    reference by what it names before that meets the parents. What is shuffled and joined grows with the values named and not with
    the rows that name them, and no key is spelled out as text.
    """
    found = []
    for table, rows in tables.items():
        checks = [(rule, holds) for rule, of, holds in _checks() if of == table]
        if checks:
            broken = rows.agg(*(F.count_if(~holds).alias(f"_{i}") for i, (_, holds) in enumerate(checks)))
            told = F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(f"_{i}").alias("violations")) for i, (rule, _) in enumerate(checks)))
            found.append(broken.select(F.lit(table).alias("table"), F.explode(told).alias("_t")).select("table", "_t.*").filter("violations > 0"))
        for key in schemas.UNIQUE_KEYS[table]:
            repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").agg(F.count(F.lit(1)).alias("violations"))
            found.append(_rule_count(repeated, table, "unique " + ", ".join(key)))
    for child, column, parent, _, _ in schemas.FOREIGN_KEYS:
        if child in tables and parent in tables:
            held = tables[parent].select(F.col(schemas.UNIQUE_KEYS[parent][0][0]).alias("_at"))
            named = tables[child].select(F.col(column).alias("_at")).filter("_at IS NOT NULL")
            if not (_whole(dict(held.dtypes)["_at"]) and _whole(dict(named.dtypes)["_at"])):
                held, named = (side.select(F.col("_at").cast("string").alias("_at")) for side in (held, named))
            missing = named.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).join(held, "_at", "left_anti").agg(F.sum("_n").alias("violations"))
            found.append(_rule_count(missing, child, f"{column} refers to {parent}"))
    return reduce(DataFrame.unionByName, found)
