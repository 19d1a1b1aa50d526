"""Column functions against worked cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from albumspark.functions import files, geo, temporal, text, vectors


def column(spark, kind, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("x"))).collect()]


def test_words(spark):
    good = "hello world pizza cafe OPEN street à ok".split()
    bad = ["bczs", "xkcd", "a12345", "24hours", "bdog", "", "-a", "a" * 40]
    assert column(spark, "string", good + bad, text.good_word) == [True] * len(good) + [False] * len(bad)


def test_good_words_split_on_any_space(spark):
    assert column(spark, "string", ["hello bczs  world", "", None], text.good_words) == [["hello", "world"], [], None]


@pytest.mark.parametrize(
    ("raw", "titled"),
    [("rome", "Rome"), ("  italy ", "Italy"), ("municipio roma i", "Municipio Roma I"), ("città del vaticano", "Città Del Vaticano"), ("state of the art", "State of the Art"), ("saint-denis", "Saint-Denis"), ("", "")],
)
def test_title(spark, raw, titled):
    assert column(spark, "string", [raw], text.title) == [titled]


def test_tags(spark):
    tags = ["Places/Italy", "Objects/Animal/Cat", "Scenes/Nature", "Landmarks/X", "People/Alice", "Vacation", "places/lower", "", None]
    assert column(spark, "string", tags, text.owned) == [True] * 4 + [False] * 5
    assert column(spark, "string", ["a/b/c", "flat", ""], text.leaf) == ["c", "flat", ""]
    assert column(spark, "array<string>", [["a", "b", "a", "c"], ["", "x", None, "x"], [], None], text.distinct_in_order) == [["a", "b", "c"], ["x"], [], None]
    assert column(spark, "array<string>", [["People/A", "X/A", "People/B", "People/A"]], text.people) == [["A", "B"]]


def test_paths(spark):
    assert column(spark, "string", ["/a/b.JPG", "/a/b", "/a.d/b", ".hid", "x.tar.gz"], text.extension) == [".jpg", "", "", "", ".gz"]
    assert column(spark, "string", ["/a/b.jpg", "/a/b.xmp"], text.other_sidecar) == ["/a/b.xmp", None]
    names = ["IMG_1353.HEIC.MOV", "a.jpg.mov", "clip.mov", "IMG_1353.HEIC", "IMG.png.mov", "regular.mp4"]
    assert column(spark, "string", names, files.motion_companion) == [True, True, False, False, False, False]


def test_urls(spark):
    assert column(spark, "string", ["A b/c~*é.jpg"], text.quoted) == ["A_b/c~%2A%C3%A9.jpg"]
    assert column(spark, "string", ["http://x/y/A%20b+c.jpg?q=1#f"], text.url_name) == ["A b+c.jpg"]


def test_small_displays(spark):
    assert column(spark, "string", ["abcdef", "abc", None], lambda c: text.shortened(c, 4)) == ["abc…", "abc", None]
    assert column(spark, "double", [59.9, 61.0, 3661.0], text.duration) == ["0:59", "1:01", "1:01:01"]
    assert [tuple(r) for r in column(spark, "int", [1, 5, 16], text.grid)] == [(1, 1), (3, 2), (4, 4)]


def test_exif_datetime(spark):
    at = dt.datetime
    cases = {
        "2026:05:07 12:34:56": at(2026, 5, 7, 12, 34), "2026-05-07T12:34:56": at(2026, 5, 7, 12, 34), "2026:05:07 12:34:56.789+02:00": at(2026, 5, 7, 12, 34),
        "2026": None, "not-a-date": None, "2026:13:07 12:34:56": None, "2026:05:07": None,
    }
    assert column(spark, "string", list(cases), lambda c: temporal.exif_datetime(c, F.lit(None).cast("string"))) == list(cases.values())
    second = lambda c: temporal.exif_datetime(c, F.lit("2026:01:02 03:04:05"))
    assert column(spark, "string", [None, "", "malformed-1"], second) == [at(2026, 1, 2, 3, 4)] * 2 + [None]


def test_name_dates(spark):
    at = dt.datetime
    cases = {
        "IMG-20230515-WA0001.jpg": (at(2023, 5, 15, 12), "whatsapp"), "signal-2023-05-15-12-34-56-789.jpg": (at(2023, 5, 15, 12, 34, 56), "signal"),
        "photo_2023-05-15_12-34-56.jpg": (at(2023, 5, 15, 12, 34, 56), "telegram"), "PXL_20230515_123456789.jpg": (at(2023, 5, 15, 12, 34, 56), "pixel"),
        "Screenshot_20230515-123456.png": (at(2023, 5, 15, 12, 34, 56), "screenshot"), "20230515_123456.jpg": (at(2023, 5, 15, 12, 34, 56), "android"),
        "trip-2023-05-15.jpg": (at(2023, 5, 15, 12), "date-only"), "PXL_20231315_123456.jpg": None, "PXL_20230515_123460.jpg": (at(2023, 5, 15, 12), "date-only"),
        "IMG_45678901.jpg": None, "": None,
    }
    got = column(spark, "string", list(cases), temporal.name_date)
    assert [g and (g["ts"], g["label"].partition(":")[2]) for g in got] == list(cases.values())


def test_unknown_source():
    with pytest.raises(ValueError, match="guess"):
        temporal.from_sources(None, None, ["guess"])


def test_coordinates(spark):
    cases = [("41.9", "12.5", None, None), ("33.9", "151.2", "S", None), ("40.7", "74.0", None, "W"), ("-33.9", "151.2", "S", None), ("north", "1", None, None), ("91", "0", None, None), ("0", "181", None, None), (None, "1", None, None)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a string, b string, c string, d string")
    got = [r[0] and tuple(r[0]) for r in rows.orderBy("k").select(geo.coordinates(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == [(41.9, 12.5), (-33.9, 151.2), (40.7, -74.0), (-33.9, 151.2), None, None, None, None]


def test_regions(spark):
    cases = [
        (41.9, 12.5, "Europe"), (40.7, -74.0, "N.America"), (-34.6, -58.4, "S.America"), (35.7, 139.7, "Asia"), (24.7, 46.7, "Asia"), (-33.9, 151.2, "Oceania"),
        (-33.9, 18.4, "Africa"), (-1.3, 36.8, "Africa"), (30.0, 31.2, "Africa"), (0.0, -150.0, "Other"),
    ]
    rows = spark.createDataFrame(cases, "lat double, lon double, want string")
    assert rows.filter(geo.region() != F.col("want")).count() == 0


def test_haversine(spark):
    rows = spark.createDataFrame([(41.9, 12.5, 48.86, 2.35, 1106.0, 0.02), (0.0, 0.0, 1.0, 0.0, 111.19, 0.01), (0.0, 0.0, 0.0, 180.0, 20015.0, 0.01), (5.0, 5.0, 5.0, 5.0, 0.0, 0.0)], "a double, b double, c double, d double, want double, off double")
    km, back = geo.haversine(*map(F.col, "abcd")), geo.haversine(*map(F.col, "cdab"))
    for r in rows.select(km.alias("km"), back.alias("back"), "want", "off").collect():
        assert abs(r["km"] - r["want"]) <= r["off"] * r["want"] + 1e-9
        assert abs(r["km"] - r["back"]) < 1e-9


def test_magic_bytes(spark):
    heads = [b"\xff\xd8\xff", b"\x89PNG\r\n", b"II*\0", b"MM\0*", b"RIFF\0\0\0\0WEBP", b"RIFF\0\0\0\0AVI ", b"\0\0\0 ftypheic", b"\0\0\0 ftypmif1", b"\0\0\0 ftypqt  ", b"\0\0\0 ftypzzzz", b"\0\0\0 ftyp", b"\x1aE\xdf\xa3", b"\xff", b"", None]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(heads)], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("x", T.BinaryType())]))
    got = [r[0] for r in rows.orderBy("k").select(files.real_type(F.col("x"))).collect()]
    assert got == ["image"] * 5 + ["video", "image", "image", "video", "video", "video", "video", None, None, None]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    got = rows.select(vectors.dot(F.col("v"), F.col("v")), vectors.normalized(F.col("v")), vectors.decoded(vectors.encoded("v"))).collect()
    assert [tuple(r) for r in got] == [(25.0, [0.6, 0.8], [3.0, 4.0]), (0.0, None, [0.0, 0.0]), (None, None, None)]
    assert column(spark, "string", ["!!", "", "AAA="], lambda c: vectors.decoded(c)) == [None, None, None]


@pytest.mark.parametrize(("raw", "titled"), [("ROMA TERMINI IV", "Roma Termini IV"), ("o'brien of d'angelo", "O'Brien of D'Angelo"), ("the iPhone", "The iPhone"), ("STATE OF THE ART", "State of the Art")])
def test_title_of_capitals_and_apostrophes(spark, raw, titled):
    assert column(spark, "string", [raw], text.title) == [titled]


def test_other_sidecars(spark):
    assert column(spark, "string", ["/a/b", "/a/.b", "/a/B.XMP", "/a.d/b"], text.other_sidecar) == ["/a/b.xmp", "/a/.b.xmp", "/a/B.xmp", "/a.d/b.xmp"]


def test_codec(spark):
    rows = [[1.0, -2.5], [], None, [0.1]]
    got = column(spark, "array<float>", rows, lambda c: vectors.decoded(vectors.encoded(c)))
    assert got[0] == [1.0, -2.5] and got[1] is None and got[2] is None and got[3] == pytest.approx([0.1])
    assert column(spark, "string", ["AACAPw==", "no", "AAA=", None, ""], vectors.decoded) == [[1.0], None, None, None, None]
