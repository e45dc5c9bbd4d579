"""Text and exam rules, table-driven."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import exam, geometry, paths, text


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_i int, " + schema)
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("_i", *columns).orderBy("_i").collect()]


HUGE = "9" * 20


@pytest.mark.parametrize(
    ("key", "right", "wrong"),
    [
        ("17", ["17", "\t17\u3000", "+17", "0017"], ["71", "17.0", "-17", "seventeen", "1 7", "", None]),
        ("0", ["0", "-0", "000"], ["", "o"]),
        (HUGE, [HUGE, f"+00{HUGE}"], [HUGE[1:], HUGE + "0", f"-{HUGE}"]),
        (f" -{HUGE} ", [f"-{HUGE}"], [HUGE]),
        ("not a number", [], ["not a number", "0"]),
        (None, [], ["17", ""]),
    ],
)
def test_part_a_replies_are_compared_as_integers(spark, key, right, wrong):
    match = exam.answer_matches(F.lit("A"), F.lit(key).cast("string"), F.col("reply"))
    replies = [*right, *wrong]
    assert values(spark, [(r,) for r in replies], "reply string", match) == [r in right for r in replies]


@pytest.mark.parametrize(
    ("key", "right", "wrong"),
    [
        ("азот", ["азот", "\x85азот "], ["Азот", "азота", ""]),
        ("osmosis/диффузия / осмос", ["osmosis", "осмос", " диффузия"], ["osmosis/диффузия / осмос", "diffusion"]),
        (" // ", [], ["", "/", " "]),
        ("", [], [""]),
        (None, [], ["anything", None]),
    ],
)
def test_part_b_replies_are_one_of_the_spellings(spark, key, right, wrong):
    match = exam.answer_matches(F.lit("B"), F.lit(key).cast("string"), F.col("reply"))
    replies = [*right, *wrong]
    assert values(spark, [(r,) for r in replies], "reply string", match) == [r in right for r in replies]


def test_digits_beyond_a_long(spark):
    stems = [("2016",), ("2016_2",), ("2016_3000000000",), (f"2016_{HUGE}",), ("x",)]
    sheet = paths.sheet_year_number(F.col("s"))
    assert values(spark, stems, "s string", sheet["sheet"]) == [1, 2, 3_000_000_000, None, None]
    files = [(f"a/00{HUGE}.png",), ("a/007.png",), ("a/n7.png",), ("a/0.JPG",)]
    assert values(spark, files, "p string", paths.question_digits(F.col("p"))) == [HUGE, "7", None, "0"]
    assert values(spark, files, "p string", paths.question_number(F.col("p"))) == [None, 7, None, 0]
    key = text.question_key(F.col("k"))
    assert values(spark, [(f"а{HUGE}",), ("b012",)], "k string", key["part"], key["number"], key["digits"]) == [("A", None, HUGE), ("B", 12, "12")]
    assert values(spark, [(f"вариант {HUGE}0 / 3",), (f"{HUGE}7",)], "t string", exam.option_of_text(F.col("t"))) == [10, 7]


def test_reject_reason(spark):
    reason = exam.reply_reject_reason(F.col("part"), F.col("key"), F.col("reply"))
    rows = [("A", "five", "5"), ("A", "6", "5"), ("A", HUGE, HUGE), ("A", "five", None), ("B", "five", "5")]
    assert values(spark, rows, "part string, reply string, key string", reason) == ["not an integer", None, None, None, None]


@pytest.mark.parametrize(
    ("raw", "normal"),
    [("А1", "A1"), ("В2", "B2"), (" a1 ", "A1"), ("b12", "B12"), ("A", None), ("1", None), ("A1B", None), ("B-1", None), ("", None), ("AB", None), ("A 1", None)],
)
def test_question_keys(spark, raw, normal):
    key = text.question_key(F.col("raw"))
    assert values(spark, [(raw,)], "raw string", text.question_key_text(key["part"], key["number"])) == [normal]


def test_option_fold(spark):
    raw = [11, 12, 20, 31, 32, 40, 1, 10, 0, -1]
    assert values(spark, [(r,) for r in raw], "n long", exam.fold_option(F.col("n"))) == [1, 2, 10, 1, 2, 10, 1, 10, 10, 9]


def test_exam_types(spark):
    rows = [(2022, 1), (2023, 5), (2023, 6), (2025, 1)]
    assert values(spark, rows, "y int, o int", exam.exam_type(F.col("y"), F.col("o"))) == ["CT", "CE", "CT", "CE"]


def test_scripts_and_markers(spark):
    assert values(spark, [("A1B2C3",), ("134",), ("F",)], "a string", text.answer_script(F.col("a"))) == ["А1В2С3", "134", "Г"]
    markers = [("Часть А",), ("ЧАСТЬ Б",), ("часть в",), ("ЧАСТЬ",), ("B",), ("",)]
    assert values(spark, markers, "t string", text.part_letter(F.col("t"))) == ["A", "B", "B", None, "B", None]
    assert values(spark, [("Вариант 12 из 30",), ("x",)], "t string", exam.option_of_text(F.col("t"))) == [2, None]
    assert values(spark, [(None,), ("x",)], "t string", text.display_answer(F.col("t"))) == ["неизвестен", "x"]


def test_numbers_of_any_length(spark):
    long = "7" * 45
    names = [f"p{long}2", f"p{long}1", f"p{'0' * 60}5", "p6", f"p{long}10"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(text.natural_sort_key(F.col("n"))).collect()]
    assert got == [f"p{'0' * 60}5", "p6", f"p{long}1", f"p{long}2", f"p{long}10"]
    folders = spark.createDataFrame([(n,) for n in ("12", "x", long, "3", "3000000000", "0")], "n string")
    assert [r.n for r in folders.orderBy(*text.natural_order(F.col("n"))).collect()] == ["0", "3", "12", "x", "3000000000", long]
    assert values(spark, [("a/3000000000.png",)], "p string", paths.question_number(F.col("p"))) == [3_000_000_000]


def test_natural_order(spark):
    names = ["page_10", "page_2", "Page_1", "7", "07b", "-1", "page", "page_2a", "123456789012345678901234567890", "99"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(text.natural_sort_key(F.col("n"))).collect()]
    import re

    def key(name):
        return [int(c) if c.isdigit() else c.lower() for c in re.split(r"(\d+)", name)]

    assert got == sorted(names, key=key)


def test_paths(spark):
    page = paths.page_subject_year(F.col("p"))
    rows = [("books/math/raw/pages/2016/1.jpg",), ("pages/2016/1.jpg",), ("math/raw/pages",), ("a/b/pages/pages/x",), ("/x/raw/pages/2016",)]
    assert values(spark, rows, "p string", page["subject"], page["year"]) == [
        ("math", "2016"), (None, None), (None, None), ("a", "pages"), ("x", "2016"),
    ]
    assert values(spark, [("a/1.jpg",), ("a/01.PNG",), ("a/1.txt",), ("a/x.jpg",), ("a/.jpg",)], "p string", paths.question_number(F.col("p"))) == [1, 1, None, None, None]
    assert values(spark, [(7,), (1000,)], "n int", paths.page_name(F.col("n"), F.lit("jpg"))) == ["007.jpg", "1000.jpg"]
    assert values(spark, [("C:\\out\\a\\1.png",), ("C:/other/1.png",)], "p string", paths.object_key("C:\\out", F.col("p"))) == ["a/1.png", None]
    sheet = paths.sheet_year_number(F.col("s"))
    assert values(spark, [("2016",), ("2016_3",), ("2016x",), ("x",)], "s string", sheet["year"], sheet["sheet"]) == [(2016, 1), (2016, 3), (2016, 1), (None, None)]


def test_task_uris(spark):
    rows = [
        ("/data/local-files/?d=images%5Cmy%20file.jpg", "images/my file.jpg"), ("https://x/y.jpg", None), ("", None),
        ("/data/local-files/?file=a&d=b", "a"), ("/x?d=a%252Fb", "a/b"), ("/x?d=a+b%2Bc", "a b+c"), ("/x?d=./a//b/./c/", "a/b/c"), ("/x#?d=a", None),
    ]
    assert values(spark, [r[:1] for r in rows], "u string", paths.local_file_path(F.col("u"))) == [r[1] for r in rows]
    data = [({"other": "/x?d=o", "image": "/x?d=i"},), ({"$undefined$": "/x?d=u", "image": "http://x"},), ({"a": "b"},)]
    assert values(spark, data, "m map<string,string>", paths.task_image_path(F.col("m"))) == ["i", "u", None]


def test_geometry(spark):
    square = [(10.0, 20.0), (50.0, 20.0), (50.0, 80.0), (10.0, 80.0)]
    df = spark.createDataFrame([(square,)], "p array<struct<x:double,y:double>>")
    row = df.select(
        geometry.percent_to_normalised(F.col("p")).alias("n"),
        geometry.label_line(F.lit(0), geometry.percent_to_normalised(F.col("p"))).alias("line"),
        geometry.bounds(F.col("p")).alias("b"),
        geometry.pixel_to_percent(F.col("p"), F.lit(200), F.lit(100)).alias("pc"),
    ).first()
    assert [(p.x, p.y) for p in row.n] == [(0.1, 0.2), (0.5, 0.2), (0.5, 0.8), (0.1, 0.8)]
    assert row.line == "0 0.100000 0.200000 0.500000 0.200000 0.500000 0.800000 0.100000 0.800000"
    assert tuple(row.b) == (10.0, 20.0, 50.0, 80.0)
    assert (row.pc[1].x, row.pc[1].y) == (25.0, 20.0)


def test_admitted_keys(spark):
    rows = [("A", "3"), ("A", "x"), ("A", ""), ("A", None), ("B", "x"), ("B", " "), ("A", "0")]
    got = exam.admitted_key(F.col("part"), F.col("raw"))
    assert values(spark, rows, "part string, raw string", got["answer"], got["keyed"]) == [
        ("3", True), (None, False), (None, False), (None, False), ("x", True), (" ", True), ("0", True),
    ]
