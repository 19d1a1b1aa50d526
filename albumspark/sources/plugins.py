"""Where models and outside services plug in: inference stays behind these interfaces, and tables stand in for it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

_LOADED: dict = {}


def once_a_worker(name: str, load: Callable[[], object]) -> object:
    """A model of the worker, loaded when first asked for."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


class Embedder(Protocol):
    def embed(self, paths: list[str]) -> list[list[float] | None]: ...


def embeddings(files: DataFrame, cache: DataFrame, load: Callable[[], Embedder] | None = None, model: str = "default", force: bool = False) -> DataFrame:
    """files (path) -> path, vec, cached: the cached vector, or the model's for files without one.

    Without a model, files that are not cached are left out; so are files whose embedding fails. force passes over the
    cache.
    """
    known = cache.select("path", "vec").join(files.select("path"), "path", "left_semi")
    hits = known.limit(0) if force else known
    hits = hits.withColumn("cached", F.lit(True))
    if load is None:
        return hits

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = once_a_worker(model, load)
        for paths in batches:
            yield pd.Series(embedder.embed(list(paths)))

    embed = F.pandas_udf(run, T.ArrayType(T.FloatType()))
    missing = files.select("path").join(hits.select("path"), "path", "left_anti")
    made = missing.withColumn("vec", embed("path")).filter("vec IS NOT NULL").withColumn("cached", F.lit(False))
    return hits.unionByName(made)


def scored(logits: DataFrame) -> DataFrame:
    """logits (path, raw_tag, logit) with score, its sigmoid; best first."""
    return logits.withColumn("score", 1 / (1 + F.exp(-F.col("logit")))).orderBy(F.desc("score"), "raw_tag")


def _by_model(files: DataFrame, table: DataFrame | None, load: Callable[[], object] | None, name: str, rows: Callable, schema: str) -> DataFrame:
    """Rows of the table for these files, or what the model gives for each file; rows(model, path) yields tuples."""
    if load is None:
        if table is None:
            raise ValueError(f"{name}: a table or a model is needed")
        return table.join(files.select("path").distinct(), "path", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, columns = once_a_worker(name, load), [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            yield pd.DataFrame([(path, *r) for path in b["path"] for r in rows(model, path)], columns=columns)

    return files.select("path").mapInPandas(run, schema)


class Tagger(Protocol):
    def tag(self, path: str) -> list[tuple[str, float, float]]: ...


def predictions(files: DataFrame, table: DataFrame | None = None, load: Callable[[], Tagger] | None = None) -> DataFrame:
    """path, raw_tag, score, class_threshold, raw_ord of each tag that the tagger predicts, best first; from a table of
    predictions where no model is given."""

    def rows(model, path):
        found = sorted(enumerate(model.tag(path)), key=lambda x: (-x[1][1], x[0]))
        return [(raw.strip(), float(score), float(threshold), k) for k, (_, (raw, score, threshold)) in enumerate(found)]

    return _by_model(files, table, load, "tagger", rows, "path string, raw_tag string, score double, class_threshold double, raw_ord long")


class OcrEngine(Protocol):
    def read(self, path: str) -> list[list[tuple[list[list[float]], str, float]]]: ...


def detections(files: DataFrame, table: DataFrame | None = None, load: Callable[[], OcrEngine] | None = None) -> DataFrame:
    """path, page_idx, det_idx, text, score, poly of each text that the engine sees; from a table where no engine is given."""

    def rows(model, path):
        return [(page, k, text, float(score), poly) for page, found in enumerate(model.read(path)) for k, (poly, text, score) in enumerate(found)]

    return _by_model(files, table, load, "ocr", rows, "path string, page_idx int, det_idx int, text string, score double, poly array<array<double>>")


class Geocoder(Protocol):
    def address(self, lat: float, lon: float) -> dict[str, str]: ...


def addresses(points: DataFrame, table: DataFrame | None = None, load: Callable[[], Geocoder] | None = None, wait_s: float = 1.1, radius_km: float = 0.5, sleep: Callable[[float], None] = time.sleep, tasks: int = 1) -> DataFrame:
    """points (seq, lat, lon) -> seq, address: that of the leader, the first point within the radius in order of seq.

    Leaders alone are asked, one after another with a wait between them, as the service demands; in several tasks, each
    waits as many times as long, so that the service is asked as seldom. Or they are looked up in a table (seq, address).
    An address that fails is empty.
    """
    from albumspark.operators.radius import leader_cache

    leaders = leader_cache(points, radius_km).filter("leader IS NOT NULL")
    if load is None:
        if table is None:
            raise ValueError("geocoder: a table or a service is needed")
        found = table.select(F.col("seq").alias("leader"), "address")
    else:
        asked = points.join(leaders.select(F.col("leader").alias("seq")).distinct(), "seq").select("seq", "lat", "lon")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            coder, first = once_a_worker("geocoder", load), True
            for b in batches:
                out = []
                for r in b.itertuples():
                    if not first:
                        sleep(wait_s * tasks)
                    first = False
                    try:
                        out.append(coder.address(r.lat, r.lon))
                    except OSError:
                        out.append({})
                yield pd.DataFrame({"leader": b["seq"], "address": out})

        found = (asked.coalesce(1) if tasks == 1 else asked.repartition(tasks)).mapInPandas(run, "leader long, address map<string,string>")
    return leaders.join(found, "leader", "left").select("seq", F.coalesce("address", F.create_map().cast("map<string,string>")).alias("address"))


class Images(Protocol):
    """Bytes in, bytes out: what ffmpeg or an imaging library does stays behind this."""

    def frame(self, video: bytes) -> bytes | None: ...

    def prepared(self, image: bytes, longest: int) -> bytes | None: ...


# What brings a picture upright, by EXIF orientation.
UPRIGHT = {1: "", 2: "hflip", 3: "hflip,vflip", 4: "vflip", 5: "transpose=0", 6: "transpose=1", 7: "transpose=3", 8: "transpose=2"}


def upright(orientation: Column) -> Column:
    """The filter that brings a picture of this orientation upright; unknown ones stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in UPRIGHT.items() for x in kv]), orientation.cast("int")), F.lit(""))


def shrunk(width: Column, height: Column, longest: int) -> Column:
    """struct(width, height) of a picture whose longer edge is at most `longest`; smaller ones stay."""
    by = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct(F.greatest(F.round(width * by).cast("int"), F.lit(1)).alias("width"), F.greatest(F.round(height * by).cast("int"), F.lit(1)).alias("height"))


def pictures(files: DataFrame, load: Callable[[], Images] | None = None, longest: int = 1024) -> DataFrame:
    """files (path, content, is_video) -> path, picture: a film's frame or the picture, prepared; null without a library, or
    where it fails."""
    if load is None:
        return files.select("path", F.lit(None).cast("binary").alias("picture"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = once_a_worker("images", load)
        for b in batches:
            still = [own.frame(c) if v else c for c, v in zip(b["content"], b["is_video"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "picture": [None if c is None else own.prepared(c, longest) for c in still]})

    return files.select("path", "content", "is_video").mapInPandas(run, "path string, picture binary")


def asked_to_wait(error: Exception) -> float | None:
    """The seconds of an HTTP error's Retry-After, if it has one in that form."""
    value = getattr(error, "headers", None) and error.headers.get("Retry-After")
    return float(value) if value and value.strip().isdigit() else None


def polite(
    call: Callable[[], object], tries: int = 3, wait_s: float = 1.0, sleep: Callable[[float], None] = time.sleep,
    retry_after: Callable[[Exception], float | None] = asked_to_wait, on: tuple[type[Exception], ...] = (OSError,),
):
    """Call until it succeeds; after an error of the network, and no other, wait as asked, or a time that grows by wait_s."""
    for k in range(tries):
        try:
            return call()
        except on as e:
            if k == tries - 1:
                raise
            sleep(retry_after(e) or wait_s * (k + 1))


class HttpRows(DataSource):
    """spark.read.format("http_rows"): url, body of each of the URLs in option urls (one a line), a partition each.

    Failed reads are tried again; a URL that fails to the end has a null body.
    """

    @classmethod
    def name(cls) -> str:
        return "http_rows"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(dict(self.options))


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        from pyspark.sql.datasource import InputPartition

        return [InputPartition(u) for u in self.options["urls"].split("\n") if u] or [InputPartition("")]

    def read(self, part):
        from urllib.request import urlopen

        if not part.value:
            return
        try:
            body = polite(lambda: urlopen(part.value, timeout=float(self.options.get("timeout", "30"))).read().decode(), int(self.options.get("tries", "3")))
        except OSError:
            body = None
        yield part.value, body
