"""Text, path, option and date rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import exam, paths, text
from paperloom.workload.views import Tables, with_views


def option_folds(spark, folder):
    raw = F.col("p_partkey") - 7
    year = (F.col("p_partkey") % 9 + 2018).cast("int")
    option = exam.fold_option(raw)
    typed = F.when(F.col("p_size") % 2 == 0, "CE").when(F.col("p_size") % 3 == 0, "ct").otherwise("CT")
    return Tables(spark, folder).read("part").select(
        "p_partkey",
        option.alias("option_number"),
        exam.exam_type(year, option).alias("exam_type"),
        exam.valid_exam_type(typed).alias("valid_type"),
    )


def subject_names(spark, folder):
    names = F.array(*[F.lit(n) for n in ("biology", "Math", "RUSSIAN", "art", "wORLD history", "social", "physics")])
    subject = F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int"))
    return Tables(spark, folder).read("documents").select("doc_id", exam.subject_name(subject).alias("subject"))


def typed_keys(spark, folder):
    """Question keys as people type them: either script, stray spaces, broken ones."""
    forms = F.array(*[F.lit(f) for f in ("A", " а", "\u00a0В", "b", "C", "", "B-", "A1B")])
    long = F.when(F.col("p_partkey") % 40 == 1, "0" * 3 + "7" * 20).otherwise("")
    raw = F.concat(F.element_at(forms, (F.col("p_partkey") % 8 + 1).cast("int")), long, F.col("p_size").cast("string"), F.lit(" \t"))
    key = text.question_key(raw)
    return Tables(spark, folder).read("part").select(
        "p_partkey",
        key["part"].alias("part"),
        key["number"].alias("number"),
        text.question_key_text(key["part"], key["digits"]).alias("normal_form"),
    )


def answer_scripts(spark, folder):
    """Whole texts with their Latin look-alike capitals in Cyrillic."""
    return Tables(spark, folder).read("documents").select("doc_id", F.md5(text.answer_script(F.col("text"))).alias("folded"))


def trimmed_texts(spark, folder):
    padded = F.concat(F.lit("\u00a0\u2003 \t"), F.col("text"), F.lit("\u3000\n\x1f"))
    return Tables(spark, folder).read("documents").select("doc_id", F.md5(text.unicode_trim(padded)).alias("trimmed"))


def marker_readings(spark, folder):
    forms = F.array(*[F.lit(f) for f in ("Часть А", "часть б", "ЧАСТЬ В", "Part B", "ЧАСТЬ", "Вариант", "x")])
    marker = F.concat(
        F.element_at(forms, (F.col("event_id") % 7 + 1).cast("int")), F.lit(" "),
        F.when(F.col("k") % 4 != 0, F.concat(F.when(F.col("k") % 9 == 2, "8" * 25).otherwise(""), F.col("k").cast("string"), F.lit(" / 9"))).otherwise(""),
    )
    return Tables(spark, folder).events.select(
        "event_id", text.part_letter(marker).alias("part"), exam.option_of_text(marker).alias("option_number")
    )


def date_texts(spark, folder):
    return Tables(spark, folder).events.select("event_id", exam.date_text(F.col("ts"), "Europe/Minsk").alias("written"))


def page_paths(spark, folder):
    """Subject, year and training name of every page path, the unparsable ones null."""
    t = page_keys(spark, folder)
    path = F.concat(F.element_at(F.array(F.lit("books/"), F.lit(""), F.lit("/srv/pages/")), (F.col("doc_id") % 3 + 1).cast("int")), F.col("object_key"))
    where = paths.page_subject_year(path)
    return t.select(
        "doc_id",
        where["subject"].alias("subject"),
        where["year"].alias("year"),
        paths.training_name(where["subject"], where["year"], paths.stem(path)).alias("training_name"),
        paths.question_number(path).alias("number"),
        paths.page_name(F.col("doc_id"), F.lit("jpg")).alias("page_name"),
        paths.object_key("books", path).alias("key_in_books"),
    )


def sheet_stems(spark, folder):
    forms = F.array(*[F.lit(f) for f in ("2016", "2017_2", "2018_x", "x2019", "20201_3", "_2021", "2016_3000000000", "2016_" + "9" * 20)])
    stem = F.concat(F.element_at(forms, (F.col("doc_id") % 8 + 1).cast("int")), F.when(F.col("doc_id") % 5 == 0, "_7").otherwise(""))
    parsed = paths.sheet_year_number(stem)
    return Tables(spark, folder).read("documents").select(
        "doc_id", parsed["year"].alias("year"), parsed["sheet"].alias("sheet")
    )


def folder_order(spark, folder):
    """Folder names in audit order: numbers by value, then the rest by name."""
    name = F.concat((F.col("p_partkey") % 97).cast("string"), F.when(F.col("p_partkey") % 5 == 0, "a").otherwise(""))
    names = Tables(spark, folder).read("part").select(name.alias("name")).distinct()
    order = text.natural_order(F.col("name"))
    place = F.coalesce(text.whole_number(F.col("name")), F.lit(2**31))
    return names.orderBy(*order).select("name", place.alias("numeric_place"))


def page_keys(spark, folder):
    """One scan path per document: subject/variant/section/year/stem.suffix."""
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in ("jpg", "jpeg", "PNG", "webp", "bmp", "gif", "tiff", "txt")])
    stem = F.when(i % 3 == 0, F.concat(F.lit("page_"), i.cast("string"))).when(i % 3 == 1, F.concat(F.lit("Scan"), i.cast("string"), F.lit("b"))).otherwise(F.format_string("%03d", i % 60))
    return Tables(spark, folder).read("documents").select(
        "doc_id",
        F.concat_ws(
            "/",
            "lang",
            F.when(i % 5 == 0, "raw").otherwise("processed"),
            F.when(i % 6 == 0, "answers").otherwise("pages"),
            (i % 4 + 2016).cast("string"),
            F.concat(stem, F.lit("."), F.element_at(kinds, (i % 8 + 1).cast("int"))),
        ).alias("object_key"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        option_folds,
        subject_names,
        typed_keys,
        answer_scripts,
        trimmed_texts,
        marker_readings,
        date_texts,
        page_paths,
        sheet_stems,
        folder_order,
    )
}

PAGE_KEYS_SQL = """page_keys AS (
  SELECT doc_id, lang || '/' || CASE WHEN doc_id % 5 = 0 THEN 'raw' ELSE 'processed' END || '/'
    || CASE WHEN doc_id % 6 = 0 THEN 'answers' ELSE 'pages' END || '/' || (doc_id % 4 + 2016)::VARCHAR || '/'
    || CASE doc_id % 3 WHEN 0 THEN 'page_' || doc_id::VARCHAR WHEN 1 THEN 'Scan' || doc_id::VARCHAR || 'b'
                       ELSE printf('%03d', doc_id % 60) END
    || '.' || ['jpg', 'jpeg', 'PNG', 'webp', 'bmp', 'gif', 'tiff', 'txt'][doc_id % 8 + 1] AS object_key FROM documents)"""
NATURAL_SQL = r"""regexp_replace(regexp_replace(lower({0}), '(\d+)', chr(1) || repeat('0', 40) || '\1' || chr(1), 'g'),
    '\d*(\d{{40}})', '\1', 'g')"""
IMAGE_SQL = r"regexp_matches(lower({0}), '[^/]\.(jpg|jpeg|png|webp|bmp|gif|tiff)$')"

_SPACES = r"""chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' '
    || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197)
    || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239)
    || chr(8287) || chr(12288)"""

SQL = {
    "option_folds": """
        WITH p AS (SELECT p_partkey, p_size, p_partkey % 9 + 2018 AS y, ((p_partkey - 8) % 10 + 10) % 10 + 1 AS o FROM part)
        SELECT p_partkey, o AS option_number, CASE WHEN y >= 2023 AND o <= 5 THEN 'CE' ELSE 'CT' END AS exam_type,
          CASE WHEN p_size % 2 = 0 THEN 'CE' WHEN p_size % 3 = 0 THEN NULL ELSE 'CT' END AS valid_type FROM p""",
    "subject_names": """
        SELECT doc_id, ['Биология', 'Математика', 'Русский язык', 'Art', 'World history', 'Обществознание', 'Физика']
          [doc_id % 7 + 1] AS subject FROM documents""",
    "typed_keys": f"""
        WITH raw AS (SELECT p_partkey, ['A', ' а', chr(160) || 'В', 'b', 'C', '', 'B-', 'A1B'][p_partkey % 8 + 1]
            || CASE WHEN p_partkey % 40 = 1 THEN '000' || repeat('7', 20) ELSE '' END || p_size::VARCHAR || ' ' || chr(9) AS r FROM part),
        folded AS (SELECT p_partkey, translate(upper(trim(r, {_SPACES})), 'АВ', 'AB') AS f FROM raw)
        SELECT p_partkey, CASE WHEN ok THEN substr(f, 1, 1) END AS part, CASE WHEN ok THEN try_cast(substr(f, 2) AS BIGINT) END AS number,
          CASE WHEN ok THEN substr(f, 1, 1) || ltrim(substr(f, 2), '0') END AS normal_form
        FROM (SELECT *, regexp_matches(f, '^[AB][0-9]+$') AS ok FROM folded)""",
    "answer_scripts": "SELECT doc_id, md5(translate(text, 'ABCEHKMOPTXYF', 'АВСЕНКМОРТХУГ')) AS folded FROM documents",
    "trimmed_texts": f"""SELECT doc_id, md5(trim(text, {_SPACES})) AS trimmed FROM documents""",
    "marker_readings": with_views(
        "ev",
        """m AS (SELECT event_id, ['Часть А', 'часть б', 'ЧАСТЬ В', 'Part B', 'ЧАСТЬ', 'Вариант', 'x'][event_id % 7 + 1]
             || ' ' || CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 9 = 2 THEN repeat('8', 25) ELSE '' END || k::VARCHAR || ' / 9' ELSE '' END AS t, k FROM ev),
           f AS (SELECT *, translate(replace(upper(t), 'ЧАСТЬ', ''), 'АБВ', 'ABB') AS u FROM m)
           SELECT event_id, CASE WHEN contains(u, 'A') THEN 'A' WHEN contains(u, 'B') THEN 'B' END AS part,
             CASE WHEN k % 4 <> 0 THEN ((k - 1) % 10 + 10) % 10 + 1 END AS option_number FROM f""",
    ),
    "date_texts": """
        SELECT event_id, day(l)::VARCHAR || ' ' || ['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа',
          'сентября', 'октября', 'ноября', 'декабря'][month(l)] || ' ' || year(l)::VARCHAR || ' в ' || strftime(l, '%H:%M') AS written
        FROM (SELECT event_id, ts + INTERVAL 3 HOUR AS l FROM events)""",
    "page_paths": f"""
        WITH {PAGE_KEYS_SQL},
        p AS (SELECT doc_id, ['books/', '', '/srv/pages/'][doc_id % 3 + 1] || object_key AS path FROM page_keys),
        s AS (SELECT *, string_split(path, '/') AS parts, list_position(string_split(path, '/'), 'pages') AS mark FROM p),
        w AS (SELECT *, coalesce(mark >= 3 AND mark < len(parts), false) AS fits, parts[len(parts)] AS file FROM s)
        SELECT doc_id, CASE WHEN fits THEN parts[mark - 2] END AS subject, CASE WHEN fits THEN parts[mark + 1] END AS year,
          CASE WHEN fits THEN parts[mark - 2] || '_' || parts[mark + 1] || '_' || regexp_replace(file, '\\.[^.]*$', '') || '.jpg' END
            AS training_name,
          CASE WHEN {IMAGE_SQL.format('path')} THEN try_cast(nullif(regexp_extract(file, '^(\\d+)\\.', 1), '') AS BIGINT) END AS number,
          printf('%03d', doc_id) || '.jpg' AS page_name,
          CASE WHEN path LIKE 'books/%' THEN substr(path, 7) END AS key_in_books
        FROM w""",
    "sheet_stems": """
        WITH s AS (SELECT doc_id, ['2016', '2017_2', '2018_x', 'x2019', '20201_3', '_2021', '2016_3000000000', '2016_' || repeat('9', 20)][doc_id % 8 + 1]
          || CASE WHEN doc_id % 5 = 0 THEN '_7' ELSE '' END AS stem FROM documents)
        SELECT doc_id, try_cast(nullif(regexp_extract(stem, '^(\\d{4})', 1), '') AS INT) AS year,
          CASE WHEN regexp_matches(stem, '^\\d{4}')
               THEN CASE WHEN regexp_matches(stem, '^\\d{4}_\\d') THEN try_cast(regexp_extract(stem, '^\\d{4}_(\\d+)', 1) AS BIGINT) ELSE 1 END
          END AS sheet FROM s""",
    "folder_order": """
        SELECT name, coalesce(try_cast(name AS BIGINT), 2147483648) AS numeric_place FROM (
          SELECT DISTINCT (p_partkey % 97)::VARCHAR || CASE WHEN p_partkey % 5 = 0 THEN 'a' ELSE '' END AS name FROM part)
        ORDER BY 2, 1""",
}
