"""Sources, sinks, the watch and the command line, over files in a temporary folder."""

import base64
import contextlib
import json
import os
import struct
import time

import pytest
from pyspark.sql import functions as F

from albumspark import cli
from albumspark.operators import moves
from albumspark.sources import files, journal, plugins, ranges, sinks, tree
from albumspark.streaming import watch


def touch(at, content=b"x", mtime=None):
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(content)
    if mtime is not None:
        os.utime(at, (mtime, mtime))


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.jpg", "sub/b.MOV", "c.txt"):
        (tmp_path / name).write_bytes(b"\xff\xd8\xff\xe0")
    rows = files.scan(spark, str(tmp_path), str(tmp_path / "sub"), with_header=True).collect()
    rows.sort(key=lambda r: r.name)
    assert [r.name for r in rows] == ["a.jpg", "b.MOV"] and bytes(rows[0].header) == b"\xff\xd8\xff\xe0"
    assert [r.root_ord for r in rows] == [0, 0] and rows[0].path == f"{tmp_path}/a.jpg"


def test_scan_passes_over_no_name(spark, tmp_path):
    names = ["_DSC0001.jpg", "a.jpg", ".hidden.PNG", "_dir/_MG_1.jpg", ".dir/x.heic", "_dir/.deep/_er/y.tif", "sp ace/é ü%20.jpg", "no suffix", ".jpg", "b.jpg/c.webm"]
    for n in names:
        touch(tmp_path / n, mtime=1_000_000_000.5)
    got = {r.path: (r.name, r.size, r.mtime.timestamp()) for r in files.scan(spark, str(tmp_path)).collect()}
    want = [n for n in names if n not in ("no suffix", ".jpg")]
    assert got == {f"{tmp_path}/{n}": (n.rsplit("/", 1)[-1], 1, 1_000_000_000.5) for n in want}
    uri = {r.path for r in files.scan(spark, f"file://{tmp_path}/").collect()}
    assert uri == {f"file://{p}" for p in got}


@pytest.mark.parametrize("entries", [1, 7, 50_000])
def test_scan_in_rounds(spark, tmp_path, entries):
    """Chains, wide and empty folders, however few entries a task meets before it hands on."""
    want = set()
    for k in range(40):
        at = f"{'/'.join(f'd{j}' for j in range(k % 9))}/w{k % 4}/f{k}.jpg".lstrip("/")
        touch(tmp_path / at)
        want.add(f"{tmp_path}/{at}")
    (tmp_path / "empty" / "er").mkdir(parents=True)
    assert {r.path for r in tree.scan(spark, str(tmp_path), entries=entries).collect()} == want


def test_scan_of_links(spark, tmp_path):
    """A file counts once however many links lead to it; links to folders are not entered, loops and broken links do no harm."""
    touch(tmp_path / "in" / "m.jpg")
    touch(tmp_path / "out" / "o.jpg")
    (tmp_path / "in" / "a.jpg").symlink_to(tmp_path / "in" / "m.jpg")
    (tmp_path / "in" / "z.png").symlink_to(tmp_path / "out" / "o.jpg")
    (tmp_path / "in" / "y.png").symlink_to(tmp_path / "out" / "o.jpg")
    (tmp_path / "in" / "folder").symlink_to(tmp_path / "out")
    (tmp_path / "in" / "loop").symlink_to(tmp_path / "in")
    (tmp_path / "in" / "gone.jpg").symlink_to(tmp_path / "nothing.jpg")
    (tmp_path / "in" / "name.txt").symlink_to(tmp_path / "out" / "o.jpg")
    names = lambda *roots: sorted((r.name, r.root_ord) for r in files.scan(spark, *roots).collect())
    assert names(str(tmp_path / "in")) == [("a.jpg", 0), ("y.png", 0)]
    assert names(str(tmp_path / "out"), str(tmp_path / "in")) == [("a.jpg", 1), ("o.jpg", 0)]
    assert names(str(tmp_path / "in" / "m.jpg")) == [("m.jpg", 0)]
    assert names(str(tmp_path / "in" / "name.txt")) == names(str(tmp_path / "none")) == []


def test_scan_reads_no_more_than_the_header(spark, tmp_path):
    """Films of 3 GB, without a block on disk."""
    for k in range(3):
        with open(tmp_path / f"{k}.mov", "wb") as f:
            f.write(b"\0\0\0\x18ftypqt  more")
            f.truncate(3 << 30)
    rows = files.scan(spark, str(tmp_path), with_header=True).collect()
    assert [(r.size, bytes(r.header)) for r in rows] == [(3 << 30, b"\0\0\0\x18ftypqt  ")] * 3


def test_metadata(spark, tmp_path):
    vec = base64.b64encode(struct.pack("<2f", 1, 2)).decode()
    (tmp_path / "m.json").write_text(json.dumps([
        {"SourceFile": "/a.jpg", "TagsList": ["Places/X", "People/Al"], "Keywords": "X", "TaggerVersion": "1", "OCRRan": True, "ClipModel": "m", "ClipEmbedding": vec, "GPSLatitude": 1.5, "GPSLongitude": "2"},
        {"SourceFile": "/b.jpg", "ClipModel": "other", "ClipEmbedding": vec},
    ]))
    meta = files.metadata(spark, str(tmp_path / "m.json"))
    assert [r.version for r in files.versions(meta).collect()] == ["1"]
    assert [r.vec for r in files.cached_embeddings(meta, "m").collect()] == [[1.0, 2.0]]
    assert [r.tags for r in files.people_tags(meta).collect()] == [["People/Al"]]
    got = {r.path: (r.keywords, r.ocr_ran, r.coords and tuple(r.coords)) for r in files.fix_inputs(meta).collect()}
    assert got == {"/a.jpg": (["Places/X", "People/Al", "X"], True, (1.5, 2.0)), "/b.jpg": ([], False, None)}


def test_manifest_round_trip(spark, tmp_path):
    at = str(tmp_path / "log")
    touch(tmp_path / "log" / "0.json", b'{"original": "/a", "moved_to": "/d/a", "ts": "2024-01-01T00:00:00Z"}\n\nbroken\n')
    log = files.manifest(spark, at)
    assert [(r.original, r.moved_to) for r in log.collect()] == [("/a", "/d/a")]
    sinks.append_manifest(log.withColumn("original", F.lit("/b")), at)
    assert sorted(r.original for r in files.manifest(spark, at).collect()) == ["/a", "/b"]
    sinks.remove_entries(spark, at, spark.createDataFrame([("/a",)], "original string"))
    assert [r.original for r in files.manifest(spark, at).collect()] == ["/b"]
    sinks.remove_entries(spark, at, spark.createDataFrame([("/b",)], "original string"))
    assert not (tmp_path / "log").exists()
    sinks.remove_entries(spark, at, spark.createDataFrame([("/b",)], "original string"))


MOVE = "original string, moved_to string, ts timestamp"


def moved(spark, *pairs):
    return spark.createDataFrame([(a, b, None) for a, b in pairs], MOVE)


def last_moves(spark, at):
    return {r.original: r.moved_to for r in moves.latest_moves(files.manifest(spark, at)).collect()}


def test_the_last_line_wins(spark, tmp_path):
    """Whatever the sizes of files and commits, in plain files as in a log."""
    plain = tmp_path / "plain"
    line = lambda a, b: json.dumps({"original": a, "moved_to": b, "ts": None})
    touch(plain / "b.json", (line("/x", "OLD") + "\n" + line("/y", "1") + "\n" + line("/y", "2")).encode(), 1000)
    touch(plain / "a.json", "\n".join([line("/x", "NEW"), *(line(f"/{k}", "z" * 50) for k in range(3000))]).encode(), 2000)
    found = last_moves(spark, str(plain))
    assert (found["/x"], found["/y"], len(found)) == ("NEW", "2", 3002)
    at = str(tmp_path / "log")
    sinks.append_manifest(moved(spark, ("/x", "OLD"), ("/y", "1"), ("/y", "2")), at)
    sinks.append_manifest(moved(spark, ("/x", "NEW"), *((f"/{k}", "z" * 50) for k in range(3000))), at)
    assert last_moves(spark, at) == found
    sinks.append_manifest(moved(spark, ("/x", "LAST")), at)
    assert last_moves(spark, at)["/x"] == "LAST"


def test_a_rewrite_that_dies_leaves_the_log(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "log")
    journal.append(moved(spark, ("/a", "1"), ("/b", "2")), at)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(journal, "_publish", dies)
        for write in (lambda: journal.append(moved(spark, ("/c", "3")), at), lambda: journal.rewrite(spark, at, lambda rows: rows.limit(1))):
            with pytest.raises(RuntimeError):
                write()
    assert last_moves(spark, at) == {"/a": "1", "/b": "2"}
    with pytest.raises(Exception, match="broken"):
        journal.rewrite(spark, at, lambda rows: rows.withColumn("ts", F.raise_error(F.lit("broken"))))
    assert last_moves(spark, at) == {"/a": "1", "/b": "2"}


def test_two_writers(spark, tmp_path, monkeypatch):
    """A number is published once: the second append takes the next, the second rewrite begins anew."""
    at = str(tmp_path / "log")
    journal.append(moved(spark, ("/a", "1")), at)
    with pytest.raises(journal.Taken):
        journal._publish(spark, at, 1, None, True)
    publish, others = journal._publish, []

    def late(session, path, *rest):
        if others:
            journal_append = others.pop()
            with pytest.MonkeyPatch.context() as m:
                m.setattr(journal, "_publish", publish)
                journal_append()
        publish(session, path, *rest)

    monkeypatch.setattr(journal, "_publish", late)
    others.append(lambda: journal.append(moved(spark, ("/b", "2")), at))
    assert journal.append(moved(spark, ("/b", "3")), at) == 3
    others.append(lambda: journal.append(moved(spark, ("/c", "4")), at))
    journal.without(spark, at, spark.createDataFrame([("/a",)], "original string"))
    assert last_moves(spark, at) == {"/b": "3", "/c": "4"}


def test_a_long_log_is_made_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(journal, "COMPACT", 3)
    at = str(tmp_path / "log")
    for k in range(9):
        journal.append(moved(spark, ("/a", str(k)), (f"/{k}", "x")), at)
    assert journal.append(moved(spark).limit(0), at) is None
    assert last_moves(spark, at) == {"/a": "8"} | {f"/{k}": "x" for k in range(9)}
    assert len(list((tmp_path / "log" / "data").iterdir())) <= 4


def test_landmarks_and_mapping(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"model": "m", "landmarks": [{"name": "A", "wikidata_id": "Q1", "lat": 1, "lon": 2, "embedding": [1.0]}, {"name": "B", "wikidata_id": "Q2", "lat": 1, "lon": 2}]}))
    assert [(r.ord, r.name, r.embedding) for r in files.landmarks(spark, str(tmp_path / "l.json")).orderBy("ord").collect()] == [(0, "A", [1.0]), (1, "B", None)]
    (tmp_path / "t.yaml").write_text('# top\ncat: Objects/Animal/Cat\n"old: dog": Objects/Dog\nthing: ~\nother: null\n')
    got = {r.raw_tag: (r.category, r.tag) for r in files.tag_mapping(spark, str(tmp_path / "t.yaml")).collect()}
    assert got == {"cat": ("Objects", "Objects/Animal/Cat"), "old: dog": ("Objects", "Objects/Dog"), "thing": (None, None), "other": (None, None)}
    (tmp_path / "u.json").write_text(json.dumps({"Q1": [{"url": "u", "source": "s"}], "Q2": ["v", "w"], "Q3": "x"}))
    got = {r.wikidata_id: [u.url for u in r.urls] for r in files.url_cache(spark, str(tmp_path / "u.json")).collect()}
    assert got == {"Q1": ["u"], "Q2": ["v", "w"], "Q3": ["x"]}


ODD_JSON = [
    '{"a": [1, {"b": "x,y]}"}, "\\\\", "q\\"[{,"], "é\\u00e9": {"k\\"": [[], {}]}, "s": "t,", "n": null, "landmarks": [{"x": [1, 2]}, [], "a,b", -1.5e3, "\\\\\\"", {}]}',
    '  [ ]  ', '{}', '[1]', '["\\\\\\\\", "]", {"landmarks": [1]}]', '{"landmarks": []}', '{"landmarks": {"p": 1, "q": [2, "}"]}, "b": 2}', '{"x": "landmarks", "y": ["landmarks"], "landmarks": [ 0 ]}',
]


@pytest.mark.parametrize("size", [3, 1 << 20])
def test_elements_of_json_at_any_range(spark, tmp_path, size, monkeypatch):
    """Strings, escapes and depths over all borders of ranges, against a parser of whole files."""
    monkeypatch.setattr(ranges, "AHEAD", 5)
    want, inner, model = [], [], []
    for k, text in enumerate(ODD_JSON):
        (tmp_path / f"{k}.json").write_text(text)
        whole = json.loads(text)
        listed = lambda x: list(enumerate(x.items() if isinstance(x, dict) else ((None, y) for y in x)))
        want += [(f"{k}.json", n, key, v) for n, (key, v) in listed(whole)]
        if isinstance(whole, dict) and isinstance(whole.get("landmarks"), list | dict):
            inner += [(f"{k}.json", n, key, v) for n, (key, v) in listed(whole["landmarks"])]
        if isinstance(whole, dict) and "b" in whole:
            model.append((f"{k}.json", whole["b"]))
    rows = lambda df: sorted(((r.path.rsplit("/", 1)[-1], r.ord, r.key, json.loads(r.value)) for r in df.collect()), key=str)
    assert rows(ranges.elements(spark, str(tmp_path), None, size)) == sorted(want, key=str)
    assert rows(ranges.elements(spark, str(tmp_path), "landmarks", size)) == sorted(inner, key=str)
    assert [(r.path.rsplit("/", 1)[-1], json.loads(r.value)) for r in ranges.member(spark, str(tmp_path), "b", size).collect()] == model


def test_no_task_reads_a_whole_file(spark, tmp_path):
    """What tasks read of a file, one by one, when elements are small."""
    text = json.dumps({"model": "m", "landmarks": [{"name": f"n{k}", "embedding": [k] * 20} for k in range(4000)]})
    (tmp_path / "l.json").write_text(text)
    (tmp_path / "log").mkdir()
    read = tree.Place.read_at

    def logged(self, path, offset, size):
        got = read(self, path, offset, size)
        if size >= 1000:
            with open(f"{tmp_path}/log/{os.getpid()}-{time.time_ns()}", "w") as f:
                f.write(str(len(got)))
        return got

    found = ranges.states(spark, str(tmp_path / "l.json"), 20_000).collect()
    assert len(found) == -(-len(text) // 20_000)
    row = found[3].asDict()
    place = tree.Place(row["path"])
    place.read_at = lambda *a: logged(place, *a)
    ahead = ranges.AHEAD
    ranges.AHEAD = 4096
    try:
        got = list(ranges._elements(place, row, 2, 0, len(text)))
    finally:
        ranges.AHEAD = ahead
    assert len(got) > 50 and sum(int(p.read_text()) for p in (tmp_path / "log").iterdir()) <= 20_000 + 2 * 4096


def test_config(tmp_path):
    base = {"a": {"x": 1, "y": 2}, "b": 3}
    assert files.merged_config(base, {"a": {"x": 9}}) == {"a": {"x": 9, "y": 2}, "b": 3}
    assert files.merged_config(base, str(tmp_path / "none.json")) == base


def test_targets(spark):
    m = spark.createDataFrame([("/a.jpg", False, "IPTC:Keywords"), ("/a.jpg", False, "XMP-dc:Subject"), ("/v.mov", True, "XMP-dc:Subject")], "path string, is_video boolean, field string")
    m = m.withColumns({"op": F.lit("+="), "value": F.lit("x")})
    assert sinks.targets(m).filter("target = path").count() == 3
    got = sorted((r.target, r.field) for r in sinks.targets(m, sidecars=True).collect())
    assert got == [("/a.jpg", "IPTC:Keywords"), ("/a.jpg", "XMP-dc:Subject"), ("/a.jpg.xmp", "XMP-dc:Subject"), ("/v.mov.xmp", "XMP-dc:Subject")]


def test_changes(spark):
    lists = spark.createDataFrame([("/a", "XMP-dc:Subject", ["Cat", "Rome"])], "path string, field string, values array<string>")
    gone = sinks.removals(spark.createDataFrame([("/a", "Objects/Cat")], "path string, tag string"))
    new = spark.createDataFrame([("/a", "XMP-dc:Subject", "+=", "Dog"), ("/a", "XMP-dc:Subject", "+=", "Rome")], "path string, field string, op string, value string")
    got = {r.field: r["values"] for r in sinks.applied(lists, gone.unionByName(new)).collect()}
    assert got["XMP-dc:Subject"] == ["Rome", "Dog"]
    people = spark.createDataFrame([("/a", ["People/Al"]), ("/z", ["People/Zo"])], "path string, tags array<string>")
    cleared = sinks.clear_all(spark.createDataFrame([("/a",), ("/b",)], "path string"), people)
    assert cleared.filter("op_seq = 0").count() == 18 and cleared.filter("op_seq = 1").count() == 5
    assert sinks.sentinel(spark.createDataFrame([("/a",)], "path string"), "1").count() == 2
    assert sinks.embeddings(spark.createDataFrame([("/a", [1.0])], "path string, vec array<float>"), "m").count() == 2


def test_watch(spark, tmp_path):
    for name in ("a.jpg", "_b.jpg", "b.jpg.mov", "done.jpg", "x.txt"):
        touch(tmp_path / "in" / name)
    seen = []

    def versions(s):
        return s.createDataFrame([(f"{tmp_path}/in/done.jpg", "1")], "path string, version string")

    def go():
        q = watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda rows, _: seen.extend(r.name for r in rows.collect()), versions, "1", once=True)
        q.awaitTermination(60)
        assert q.exception() is None

    go()
    assert sorted(seen) == ["_b.jpg", "a.jpg"]
    go()
    assert len(seen) == 2
    # Copied photos keep their time; a file that changes, or that is at the current version no more, was seen.
    touch(tmp_path / "in" / "new" / "c.png", mtime=time.time() - 30 * 86400)
    touch(tmp_path / "in" / "a.jpg", b"changed")
    touch(tmp_path / "in" / "old.jpg", mtime=1)
    go()
    assert sorted(seen[2:]) == ["c.png", "old.jpg"]
    (tmp_path / "in" / "link.jpg").symlink_to(tmp_path / "in" / "old.jpg")
    go()
    assert len(seen) == 4
    with pytest.raises(ValueError, match="one directory"):
        watch.watch(spark, "a,b", str(tmp_path / "cp"), print)


def test_watch_again_after_a_failure(spark, tmp_path):
    touch(tmp_path / "in" / "a.jpg")
    seen = []

    def fails(rows, _):
        raise RuntimeError("no service")

    def go(process):
        q = watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), process, once=True)
        with contextlib.suppress(Exception):
            q.awaitTermination(60)

    go(fails)
    go(lambda rows, _: seen.extend(r.name for r in rows.collect()))
    assert seen == ["a.jpg"]


def test_watch_sets_failing_files_aside(spark, tmp_path):
    for k in range(6):
        touch(tmp_path / "in" / f"{k}.jpg", b"x" * k)

    def each(row):
        if row["size"] == 3:
            raise OSError("broken")
        (tmp_path / "done").mkdir(exist_ok=True)
        (tmp_path / "done" / row["name"]).write_text("ok")

    for _ in range(2):
        watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), each=each, once=True).awaitTermination(60)
    assert sorted(p.name for p in (tmp_path / "done").iterdir()) == ["0.jpg", "1.jpg", "2.jpg", "4.jpg", "5.jpg"]
    assert [(r.path, r.error, r.batch_id) for r in watch.failures(spark, str(tmp_path / "cp")).collect()] == [(f"{tmp_path}/in/3.jpg", "OSError: broken", 0)]
    assert watch.failures(spark, str(tmp_path / "none")).collect() == []


def test_embeddings(spark):
    class Model:
        def embed(self, paths):
            return [[float(len(p))] for p in paths]

    paths = spark.createDataFrame([("/a",), ("/bb",)], "path string")
    cache = spark.createDataFrame([("/a", [9.0])], "path string, vec array<float>")
    got = {r.path: (r.vec, r.cached) for r in plugins.embeddings(paths, cache, Model).collect()}
    assert got == {"/a": ([9.0], True), "/bb": ([3.0], False)}
    assert plugins.embeddings(paths, cache).count() == 1


def test_polite():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert plugins.polite(call, sleep=waits.append) == "ok" and waits == [1.0, 2.0]


def test_cli(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"SourceFile": "/a/PXL_20230515_123456.jpg", "TagsList": ["Objects/Cat"]}, {"SourceFile": "/b.jpg", "TagsList": "Objects/Cat"}]))
    out = str(tmp_path / "out")
    for command, n in ((["tags", "list"], 1), (["tags", "search", "CAT"], 2), (["tags", "delete", "c.t", "--pattern"], 8), (["dates", "backfill"], 6), (["tag", "plan"], 2)):
        k = 2
        cli_args = [*command[:k], str(tmp_path / "m.json"), *command[k:], "--out", out]
        a = cli.parser().parse_args(cli_args)
        a.f(spark, a).write.mode("overwrite").json(out)
        assert spark.read.json(out).count() == n, command


def test_changes_in_order(spark):
    lists = spark.createDataFrame([("/a", "S", ["x"])], "path string, field string, values array<string>")

    def after(*ops):
        m = spark.createDataFrame([("/a", "S", o, v, k) for k, (o, v) in enumerate(ops)], "path string, field string, op string, value string, op_seq int")
        return sinks.applied(lists, m).first()["values"]

    assert after(("=", ""), ("+=", "a"), ("-=", "a")) == [] and after(("+=", "new2"), ("+=", "new1")) == ["x", "new2", "new1"]
    assert after(("=", "b"), ("=", "a"), ("+=", "x")) == ["b", "a", "x"] and after(("-=", "x"), ("+=", "x")) == ["x"]
    none = sinks.applied(lists, spark.createDataFrame([], "path string, field string, op string, value string"))
    assert none.first()["values"] == ["x"]


def test_removals_and_missing_sidecars(spark):
    gone = sinks.removals(spark.createDataFrame([("/a", "Objects/Cat"), ("/b", "People/Al")], "path string, tag string"))
    assert sorted((r.field, r.value) for r in gone.filter("path = '/a'").collect()) == [("IPTC:Keywords", "Cat"), ("XMP-dc:Subject", "Cat"), ("XMP-digiKam:TagsList", "Objects/Cat"), ("XMP-lr:HierarchicalSubject", "Objects|Cat")]
    assert gone.filter("path = '/b' AND field LIKE '%PersonInImage' AND value = 'Al'").count() == 1
    rows = spark.createDataFrame([("/a.jpg",), ("/a.jpg.xmp",), ("/b.jpg.xmp",)], "target string")
    assert sorted(r.target for r in sinks.on_existing(rows, spark.createDataFrame([("/b.jpg.xmp",)], "path string")).collect()) == ["/a.jpg", "/b.jpg.xmp"]


def test_mapping_of_objects(spark):
    got = files.tag_mapping_of(spark, {"cat": {"category": "Objects", "tag": "Animal/Cat"}, "x": None, "y": "Scenes/Y"})
    assert sorted(tuple(r) for r in got.collect()) == [("cat", "Objects", "Animal/Cat"), ("x", None, None), ("y", "Scenes", "Scenes/Y")]


def test_plugins_stand_behind_tables(spark):
    paths = spark.createDataFrame([("/a",)], "path string")
    table = spark.createDataFrame([("/a", "t", 0.5), ("/z", "t", 0.5)], "path string, raw_tag string, score double")
    assert plugins.predictions(paths, table).count() == plugins.detections(paths, table).count() == 1
    rows = spark.createDataFrame([("/a", b"ab", False), ("/v", b"cd", True)], "path string, content binary, is_video boolean")

    class Pictures:
        def frame(self, video):
            return None

        def prepared(self, image, longest):
            return image[:1] * longest

    assert {r.path: r.picture and bytes(r.picture) for r in plugins.pictures(rows, Pictures, 3).collect()} == {"/a": b"aaa", "/v": None}
    assert plugins.pictures(rows).filter("picture IS NULL").count() == 2


def test_waits_as_asked():
    from urllib.error import HTTPError

    waits = []

    def call():
        if not waits:
            raise HTTPError("u", 429, "slow", {"Retry-After": "7"}, None)
        return 1

    assert plugins.polite(call, sleep=waits.append) == 1 and waits == [7.0]


def run_cli(spark, *args):
    a = cli.parser().parse_args([str(x) for x in args])
    return a.f(spark, a)


def test_cli_changes(spark, tmp_path):
    region = {"Name": "x", "Type": "BarCode", "Description": "text"}
    (tmp_path / "m.json").write_text(json.dumps([
        {"SourceFile": "/a.jpg", "TagsList": ["Objects/Cat", "People/Al"], "TaggerVersion": "1", "GPSLatitude": 1, "GPSLongitude": 2, "ImageRegion": [region, {"Name": "y"}]},
        {"SourceFile": "/b.HEIC.MOV", "TagsList": "Objects/Cat", "ImageRegion": [region]},
    ]))
    meta = tmp_path / "m.json"
    assert run_cli(spark, "tags", "clear", meta).count() == 2 * 9 + 5 and run_cli(spark, "strip", "motion", meta).count() == 9
    assert {r.value for r in run_cli(spark, "tags", "rename", meta, "cat", "Dog").filter("op = '+='").collect()} == {"dog"}
    shown = {r.path: r for r in run_cli(spark, "tags", "inspect", meta).collect()}
    assert shown["/a.jpg"].gps == "1.000000, 2.000000" and shown["/b.HEIC.MOV"].gps == "—" and shown["/a.jpg"].tags == ["Objects/Cat", "People/Al"]
    assert {r.path: r.action for r in run_cli(spark, "strip", "regions", meta, "text").collect()} == {"/a.jpg": "rewrite", "/b.HEIC.MOV": "delete"}
    (tmp_path / "map.yaml").write_text("cat: Objects/Animal/Cat\nsky: Scenes/Sky\n")
    assert [r.node for r in run_cli(spark, "taxonomy", tmp_path / "map.yaml", "--category", "Objects").collect()] == ["Objects", "Objects/Animal", "Objects/Animal/Cat"]
    assert run_cli(spark, "taxonomy", tmp_path / "map.yaml", "--flat").count() == 2
    predictions = str(tmp_path / "p")
    spark.createDataFrame([("/a.jpg", "cat", 0.9, 0, 0.5), ("/b.HEIC.MOV", "cat", 0.9, 0, 0.5)], "path string, raw_tag string, score double, raw_ord int, class_threshold double").write.parquet(predictions)
    args = ("tag", "write", meta, predictions, tmp_path / "map.yaml")
    assert {r.path for r in run_cli(spark, *args).collect()} == {"/b.HEIC.MOV"} and run_cli(spark, *args, "--force").select("path").distinct().count() == 2


def test_cli_landmarks_and_watch(spark, tmp_path):
    items = str(tmp_path / "items")
    rows = [(f"Q{k}", f"n{k}", 45.0 if k % 2 else 30.0, 10.0 if k % 2 else 100.0, k, "museum" if k % 3 else "cave") for k in range(40)]
    spark.createDataFrame(rows, "wikidata_id string, name string, lat double, lon double, sitelinks int, type string").write.parquet(items)
    got = run_cli(spark, "landmarks", "generate-db", items, "--limit", 20).collect()
    assert sum(r.region == "Europe" for r in got) == 8 and sum(r.region == "Asia" for r in got) == 5
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(b"x")
    assert [r.name for r in run_cli(spark, "tag", "watch", tmp_path / "in", "--once", "--out", tmp_path / "out").collect()] == ["a.jpg"]
    for flags in (("--fix", "--out", "x"), ("--once",)):
        with pytest.raises(SystemExit):
            run_cli(spark, "tag", "watch", tmp_path / "in", *flags)
