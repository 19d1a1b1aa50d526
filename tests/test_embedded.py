"""Metadata in files, and sidecars."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from albumspark import cli
from albumspark.operators import merge
from albumspark.plans import pictures
from albumspark.sources import embedded, files, sidecars, sinks, tree, xmp

REGION = {"Name": "a <b>", "RRole": [{"Identifier": ["http://x/annotatedText", "y"], "Name": "n"}], "RegionBoundary": {"RbX": "0.1", "RbY": "0.2"}}
PACKET = xmp.changed(None, {"XMP-dc:Subject": ["Rome", "é"], "XMP-digiKam:TagsList": ["Places/Rome"], "XMP-album:TaggerVersion": ["9"], "XMP-album:OCRRan": ["True"], "XMP-album:CountryCode": ["IT"], "XMP-album:ClipModel": ["m"], "XMP-album:ClipEmbedding": ["AAAA"], "XMP-album:OCRText": ["one", "two"], "XMP-iptcExt:ImageRegion": [json.dumps(REGION), '{"Name":"s"}']})
MAIN = {0x010F: "Maker", 0x0110: "M", 0x0100: 4000, 0x0101: 3000}
EXIF, GPS = {0x9003: "2020:01:02 03:04:05", 0x9004: "2020:01:02 03:04:06"}, {1: "S", 2: pictures.rationals(33.875), 3: "E", 4: pictures.rationals(151.25)}
OF_TIFF = {"Make": "Maker", "Model": "M", "ImageWidth": "4000", "ImageHeight": "3000", "DateTimeOriginal": "2020:01:02 03:04:05", "CreateDate": "2020:01:02 03:04:06", "GPSLatitude": "33.875", "GPSLongitude": "151.25", "GPSLatitudeRef": "S", "GPSLongitudeRef": "E"}
OF_XMP = {"Subject": ["Rome", "é"], "TagsList": ["Places/Rome"], "TaggerVersion": "9", "OCRRan": "True", "CountryCode": "IT", "ClipModel": "m", "ClipEmbedding": "AAAA", "OCRText": ["one", "two"]}
SIZE = {"FileImageWidth": "640", "FileImageHeight": "480"}


def made(order):
    exif = pictures.tiff(MAIN, EXIF, GPS, order)
    return {
        "a.jpg": (pictures.jpeg(640, 480, exif, PACKET, ["k1", "ü2"]), OF_TIFF | OF_XMP | SIZE | {"Keywords": ["k1", "ü2"]}),
        "a.png": (pictures.png(640, 480, exif, PACKET), OF_TIFF | OF_XMP | SIZE),
        "a.webp": (pictures.webp(640, 480, exif, PACKET), OF_TIFF | OF_XMP | SIZE),
        "a.tif": (pictures.tiff(MAIN | {0x02BC: PACKET, 0x83BB: pictures.iptc(["k1"])}, EXIF, GPS, order), OF_TIFF | OF_XMP | {"Keywords": ["k1"]}),
        "a.jpg.xmp": (PACKET, OF_XMP),
        "bare.jpg": (pictures.jpeg(640, 480), SIZE),
        "a.mov": (b"\0\0\0\x18ftypqt  ", {}),
        "empty.jpg": (b"", {}),
    }


@pytest.mark.parametrize("order", ["<", ">"])
def test_fields_of_files(spark, tmp_path, order):
    for name, (data, _) in made(order).items():
        (tmp_path / name).write_bytes(data)
    rows = embedded.embedded(spark.createDataFrame([(f"{tmp_path}/{n}",) for n in made(order)], "path string"))
    for r in rows.collect():
        got = {k: v for k, v in r.asDict().items() if v is not None and k != "path"}
        want = dict(made(order)[os.path.basename(r.path)][1])
        if "Subject" in want:
            assert json.loads(got.pop("ImageRegion")) == [REGION, {"Name": "s"}]
        assert got == want, r.path
    # What works on a dump works on files.
    found = files.fields(rows.filter(F.col("path").endswith("a.jpg"))).first()
    assert tuple(found.coords) == (-33.875, 151.25) and found.ImageWidth == 4000 and found.ImageRegion[0].Name == "a <b>"
    assert {os.path.basename(r.path) for r in files.versions(rows).collect()} == {"a.jpg", "a.png", "a.webp", "a.tif", "a.jpg.xmp"}


def test_files_with_sidecars(spark, tmp_path, capsys):
    """Lists of a file and its sidecar are united, other fields are the sidecar's; the commands read folders so."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(pictures.jpeg(640, 480, pictures.tiff(MAIN, EXIF), xmp.changed(None, {"XMP-dc:Subject": ["Rome", "Cat"], "XMP-album:TaggerVersion": ["1"]})))
    (tmp_path / "in" / "a.jpg.xmp").write_bytes(xmp.changed(None, {"XMP-dc:Subject": ["Dog", "Rome"], "XMP-album:TaggerVersion": ["2"]}))
    (tmp_path / "in" / "b.png").write_bytes(pictures.png(10, 20)[:20])
    at = str(tmp_path / "in")
    rows = embedded.merged_files(merge.with_sidecars(files.scan(spark, at).select("path"), tree.listed(spark, at)))
    got = {os.path.basename(r.path): r for r in rows.collect()}
    assert set(got) == {"a.jpg", "b.png"} and got["b.png"].error and not got["a.jpg"].error
    assert (got["a.jpg"].Subject, got["a.jpg"].TaggerVersion, got["a.jpg"].Make) == (["Rome", "Cat", "Dog"], "2", "Maker")
    cli.main(["tags", "list", str(tmp_path / "in"), "--files"])
    assert sorted(json.loads(x)["tag"] for x in capsys.readouterr().out.strip().splitlines()) == ["cat", "dog", "rome"]


def test_damaged_files(spark, tmp_path):
    """Cut anywhere, or with any byte changed: a row each, with an error or what is left; never a failure."""
    rnd, paths = random.Random(3), []
    for name, (data, _) in made("<").items():
        for k in range(30):
            bad = bytearray(data[: rnd.randrange(len(data) + 1)] if k % 2 else data)
            for _ in range(0 if k % 2 else 3):
                if bad:
                    bad[rnd.randrange(len(bad))] = rnd.randrange(256)
            paths.append(tmp_path / f"{k}-{name}")
            paths[-1].write_bytes(bytes(bad))
    rows = embedded.embedded(spark.createDataFrame([(str(p),) for p in [*paths, tmp_path / "gone.jpg"]], "path string")).collect()
    assert len(rows) == len(paths) + 1
    by = {os.path.basename(r.path): r for r in rows}
    assert by["gone.jpg"].error.startswith("FileNotFoundError")
    (tmp_path / "cut.jpg").write_bytes(made("<")["a.jpg"][0][:-20])
    (r,) = embedded.embedded(spark.createDataFrame([(str(tmp_path / "cut.jpg"),)], "path string")).collect()
    assert r.error.startswith("Damaged") and r.Make == "Maker" and r.Keywords == ["k1", "ü2"]


def test_samples_are_not_read():
    data, _ = made("<")["a.jpg"]
    data = data[:-2] + b"\0" * 10**6 + b"\xff\xd9"
    read = []

    def at(x, n):
        read.append(len(data[x : x + n]))
        return data[x : x + n]

    assert "error" not in embedded.of_file(at, "a.jpg") and sum(read) < 10_000


def test_packets():
    """Other fields stay, also in attributes and of unknown groups; odd characters go."""
    old = b"""<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
      <rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:o="urn:other" xmp:CreateDate="2020" o:kept="1"><o:more>x</o:more></rdf:Description>
      <rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:subject><rdf:Bag><rdf:li>a</rdf:li></rdf:Bag></dc:subject><dc:title><rdf:Alt><rdf:li xml:lang="x-default">t</rdf:li></rdf:Alt></dc:title></rdf:Description>
    </rdf:RDF></x:xmpmeta>"""
    assert xmp.fields(old) == {"XMP-xmp:CreateDate": ["2020"], "XMP-dc:Subject": ["a"], "XMP-dc:Title": ["t"]}
    new = xmp.changed(old, {"XMP-dc:Subject": ["b", "c\x01d<&>\n"], "XMP-xmp:CreateDate": [], "IPTC:City": ["x"], "XMP-none:X": ["x"], "XMP-photoshop:City": ["Rome"]})
    assert xmp.fields(new) == {"XMP-dc:Title": ["t"], "XMP-dc:Subject": ["b", "cd<&>\n"], "XMP-photoshop:City": ["Rome"]}
    assert b"urn:other" in new and b"more" in new
    for bad in (b"", b"<a>", b"<a/>", b"\xff\xfe\0"):
        with pytest.raises(ValueError):
            xmp.fields(bad)


def changes(seed, targets):
    rnd = random.Random(seed)
    fields = ["XMP-dc:Subject", "XMP-digiKam:TagsList", "XMP-photoshop:City", "XMP-iptcExt:PersonInImage"]
    return [(t, rnd.choice(fields), rnd.choice(["=", "+=", "+=", "-="]), rnd.choice(["a", "b", "c/d", "", "é"]), rnd.randrange(3)) for t in targets for _ in range(rnd.randrange(1, 9))]


MUTATION = "target string, field string, op string, value string, op_seq int"


def listed(spark, targets):
    rows = sidecars.read(spark.createDataFrame([(t,) for t in targets], "path string")).collect()
    return {(r.path, r.field): r["values"] for r in rows}


def test_sidecars_are_as_applied(spark, tmp_path):
    """Three jobs, against the same changes as tables."""
    targets = [f"{tmp_path}/{k}.jpg.xmp" for k in range(12)]
    state = spark.createDataFrame([], "path string, field string, values array<string>")
    for seed in range(3):
        own = [m for m in changes(seed, targets) if not (m[2] == "+=" and m[3] == "")]
        df = spark.createDataFrame(own, MUTATION)
        assert sidecars.write(df, str(tmp_path / f"job{seed}")).filter("error IS NOT NULL").count() == 0
        rows = sinks.applied(state, df.withColumnRenamed("target", "path")).collect()
        want = {(r.path, r.field): r["values"] for r in rows if r["values"]}
        assert listed(spark, targets) == want
        state = spark.createDataFrame([(*k, v) for k, v in want.items()], "path string, field string, values array<string>")


def test_a_job_counts_once(spark, tmp_path):
    """Nothing changes before it is published; a second phase that died half way is finished by the next; giving up leaves
    the folder as it was."""
    targets = [f"{tmp_path}/in/{k}.xmp" for k in range(5)]
    (tmp_path / "in").mkdir()
    change = lambda v: spark.createDataFrame([(t, "XMP-dc:Subject", "+=", v, 0) for t in targets], MUTATION)
    sidecars.write(change("a"), str(tmp_path / "one"))
    job = str(tmp_path / "two")
    staged = sidecars.stage(change("b"), job)
    assert set(listed(spark, targets).values().__iter__().__next__()) == {"a"} and not sidecars.is_published(spark, job)
    with pytest.raises(ValueError, match="not published"):
        sidecars.put(spark, job)
    sidecars.publish(spark, job)
    first = staged.first()
    os.replace(first.staged, first.target)  # the second phase died after one
    assert sidecars.put(spark, job) == 4 and sidecars.put(spark, job) == 0
    assert all(v == ["a", "b"] for v in listed(spark, targets).values())
    with pytest.raises(ValueError, match="is published"):
        sidecars.give_up(spark, job)
    other = str(tmp_path / "three")
    sidecars.stage(change("c"), other)
    sidecars.give_up(spark, other)
    assert all(v == ["a", "b"] for v in listed(spark, targets).values()) and len(list((tmp_path / "in").iterdir())) == 5


def test_damaged_sidecars_stay(spark, tmp_path):
    (tmp_path / "bad.xmp").write_text("no xml")
    rows = [(f"{tmp_path}/bad.xmp", "XMP-dc:Subject", "+=", "a", 0), (f"{tmp_path}/good.xmp", "XMP-dc:Subject", "+=", "a", 0), (f"{tmp_path}/p.jpg", "XMP-dc:Subject", "+=", "a", 0)]
    got = {os.path.basename(r.target): r.error is not None for r in sidecars.write(spark.createDataFrame(rows, MUTATION), str(tmp_path / "job")).collect()}
    assert got == {"bad.xmp": True, "good.xmp": False} and (tmp_path / "bad.xmp").read_text() == "no xml"


def test_few_bytes_are_dealt_to_several_tasks(spark, tmp_path):
    """Changes of many sidecars are few bytes, which must not put all files into one task; nor do files to read that stand in
    one part."""
    targets = [f"{tmp_path}/{k}.xmp" for k in range(200)]
    rows = spark.createDataFrame([(t, "XMP-dc:Subject", "+=", "a", 0) for t in targets], MUTATION)
    staged = sidecars.stage(rows, str(tmp_path / "job"))
    assert staged.count() == 200 and staged.select(F.input_file_name()).distinct().count() > 4
    sidecars.publish(spark, str(tmp_path / "job"))
    assert sidecars.put(spark, str(tmp_path / "job")) == 200
    found = sidecars.read(rows.select(F.col("target").alias("path")).coalesce(1))
    assert found.count() == 200 and found.select(F.spark_partition_id()).distinct().count() > 4
