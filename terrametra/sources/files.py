"""Registry, archive, listing and export files."""

from __future__ import annotations

import re

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrametra.functions import geo, text
from terrametra.functions.numeric import half_up
from terrametra.operators.ranking import keep_first, keep_last

# Alternative header names of registry columns, first match wins.
REGISTRY_ALIASES = {
    "state_code": ["cve_ent"],
    "town_code": ["cve_mun"],
    "state": ["entidad", "nom_ent"],
    "town": ["municipio", "nom_mun"],
    "activity_code": ["codigo_act", "cod_actividad"],
    "activity": ["nombre_act", "nombre_actividad"],
    "band": ["per_ocu", "personal_ocupado"],
    "added_on": ["fecha_alta"],
    "postal_code": ["cod_postal"],
    "name": ["nom_estab", "nombre"],
    "street_kind": ["tipo_vial"],
    "street": ["nom_vial", "nombre_vialidad"],
    "lat": ["latitud", "lat"],
    "lng": ["longitud", "lng", "lon"],
}


def bind_headers(df: DataFrame, aliases: dict[str, list[str]], required: list[str] | None = None) -> DataFrame:
    """Select the first present alias of every field (case-insensitive); absent fields are NULL text."""
    have = {c.strip().lstrip("﻿").lower(): c for c in df.columns}
    out = []
    for field, names in aliases.items():
        hit = next((have[n] for n in names if n in have), None)
        if hit is None and field in (required or []):
            raise KeyError(f"column not found: {names}")
        out.append(F.col(f"`{hit}`").alias(field) if hit else F.lit(None).cast("string").alias(field))
    return df.select(*out)


def scan_registry(spark: SparkSession, path, aliases: dict[str, list[str]] = REGISTRY_ALIASES, fields: list[str] | None = None, required: list[str] | None = None) -> DataFrame:
    """Latin-1 CSV with header; only the bound columns are parsed."""
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("quote", '"').option("escape", '"').csv(path)
    wanted = {k: aliases[k] for k in (fields or aliases)}
    return bind_headers(raw, wanted, required)


# One CSV record with its line end: a quote opens a field only at its start, and line ends within it do not end the record.
RECORD = re.compile(rb'(?:"(?:[^"]++|"")*+"[^,\n]*+|[^",\n][^,\n]*+|,)*+\n')


def record_blocks(stream, size: int) -> Iterator[bytes]:
    """The stream in pieces of whole CSV records, about ``size`` bytes each; only a longer record makes a longer piece."""
    held = b""
    while part := stream.read(max(size, len(held))):
        held += part
        start = end = 0
        while found := RECORD.match(held, end):
            end = found.end()
            if end - start >= size:
                yield held[start:end]
                start = end
        if end > start:
            yield held[start:end]
        held = held[end:]
    if held:
        yield held


def archive_blocks(archives: DataFrame, size: int = 1 << 20) -> DataFrame:
    """``archive, at, head, body``: the largest CSV member of each ZIP in ``(path, content)`` as blocks of records.

    ``head`` is the header record. An archive is inflated as a stream: its task holds the packed archive and one block.
    Null contents and archives without a CSV member give no row.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                if content is None:
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [m for m in z.infolist() if m.filename.lower().endswith(".csv")]
                    if not members:
                        continue
                    head = None
                    with z.open(max(members, key=lambda m: m.file_size)) as f:
                        for at, body in enumerate(record_blocks(f, size)):
                            if head is None:
                                body = body.lstrip(b"\r\n")
                                first = RECORD.match(body)
                                head, body = (first.group(), body[first.end() :]) if first else (body or None, b"")
                            if body:
                                yield pd.DataFrame({"archive": [path], "at": [at], "head": [head], "body": [body]})

    return archives.select("path", "content").mapInPandas(read, "archive string, at bigint, head binary, body binary")


def unpack_archives(archives: DataFrame, columns: list[str], encoding: str = "latin-1", size: int = 1 << 20) -> DataFrame:
    """Rows of the largest CSV member of each ZIP in ``(path, content)``, as text columns; absent columns are NULL.

    Inflating is one stream per archive; its blocks are dealt out, so the records of one archive are parsed in many tasks.
    """
    schema = T.StructType([T.StructField("archive", T.StringType())] + [T.StructField(c, T.StringType()) for c in columns])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, head, body in zip(batch["archive"], batch["head"], batch["body"]):
                part = pd.read_csv(io.BytesIO(head + body), encoding=encoding, dtype=str, keep_default_na=False, na_values=[""])
                part = part.rename(columns=lambda c: c.strip().lower()).reindex(columns=columns)
                part.insert(0, "archive", path)
                yield part.astype(object).where(part.notna(), None)

    return archive_blocks(archives, size).repartition("archive", "at").select("archive", "head", "body").mapInPandas(parse, schema)


def scan_archives(spark: SparkSession, glob: str, columns: list[str]) -> DataFrame:
    """ZIP files below ``glob`` through the binary file source, one file per record."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    # one packed archive per record; what it holds is dealt out in blocks
    return unpack_archives(files.repartition(F.col("path")), columns)


def union_parts(parts: list[DataFrame], key: str, done: DataFrame | None = None) -> DataFrame:
    """Concatenate file parts, skip finished keys, keep the first part's row per key."""
    out = None
    for i, p in enumerate(parts):
        tagged = p.withColumn("_part", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if done is not None:
        out = out.join(done.select(key).distinct(), key, "left_anti")
    rest = [c for c in out.columns if c not in (key, "_part")]
    return keep_first(out, [key], ["_part", *rest]).drop("_part")


def write_gz_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("compression", "gzip").csv(path)


def read_gz_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


STREET_DOCUMENT = "municipio string, estado string, calles array<struct<nombre:string,camino:array<array<double>>>>"


def scan_streets(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Street documents to rows ``(town, state, street, path)`` with vertices as structs."""
    docs = spark.read.schema(STREET_DOCUMENT).option("multiLine", multiline).json(path)
    rows = docs.select(F.col("municipio").alias("town"), F.col("estado").alias("state"), F.explode("calles").alias("c"))
    return rows.select("town", "state", F.col("c.nombre").alias("street"), to_points(F.col("c.camino")).alias("path"))


def to_points(pairs: Column) -> Column:
    """``[[lng, lat], ...]`` to array of structs."""
    return F.transform(pairs, lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat")))


FEATURE = "struct<type:string,properties:map<string,string>,geometry:string>"


def scan_geojson(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """FeatureCollections to ``(properties map, rings)``; Polygon and MultiPolygon rings end in one list."""
    docs = spark.read.schema(f"features array<{FEATURE}>").option("multiLine", multiline).json(path)
    return parse_features(docs.select(F.explode("features").alias("f")).select("f.properties", "f.geometry"))


def parse_features(df: DataFrame) -> DataFrame:
    """``(properties, geometry json)`` to ``(properties, rings)``."""
    kind = F.get_json_object("geometry", "$.type")
    one = F.from_json("geometry", "struct<coordinates:array<array<array<double>>>>")["coordinates"]
    many = F.from_json("geometry", "struct<coordinates:array<array<array<array<double>>>>>")["coordinates"]
    rings = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", F.flatten(many))
    return df.select("properties", F.transform(rings, to_points).alias("rings")).filter("rings is not null")


def geo_cells(features: DataFrame) -> DataFrame:
    """Cells with area key, name, rings, box and interior point from parsed features."""
    p = F.col("properties")
    pad = lambda c, n: F.lpad(c.try_cast("double").try_cast("bigint").cast("string"), n, "0")
    point = geo.interior_point(F.col("rings"))
    return features.select(
        F.concat(pad(p["state_code"], 2), pad(p["mun_code"], 3)).alias("cell_id"),
        p["mun_name"].alias("name"),
        "rings",
        geo.bbox(F.col("rings")).alias("box"),
        point["lng"].alias("lng"),
        point["lat"].alias("lat"),
    )


def compact_rings(df: DataFrame, digits: int = 4, minimum: int = 4) -> DataFrame:
    """Scaled integer rings without repeated vertices; short rings and empty shapes drop out, with their box."""
    scale = float(10**digits)
    ints = F.transform(
        "rings", lambda r: F.transform(r, lambda q: F.struct(F.rint(q["lng"] * scale).alias("lng"), F.rint(q["lat"] * scale).alias("lat")))
    )
    slim = F.filter(F.transform(ints, lambda r: geo.drop_repeats(r)), lambda r: F.size(r) >= minimum)
    return df.withColumn("rings", slim).filter(F.size("rings") > 0).withColumn("box", geo.bbox(F.col("rings")))


def listing_key() -> Column:
    """The id when present, else the url, else title, price and location."""
    own = F.concat(F.lit("id:"), F.col("id").cast("string"))
    text_key = F.concat_ws("|", F.coalesce("title", F.lit("")), F.col("price").cast("string"), F.coalesce("location", F.lit("")))
    return F.coalesce(own, F.col("url"), text_key)


def append_unseen(store: DataFrame, batch: DataFrame, key: str = "key") -> DataFrame:
    """Batch records whose key the store does not hold, the first of each key in batch order (``seq``)."""
    fresh = batch.join(store.select(key).distinct(), key, "left_anti")
    return keep_first(fresh, [key], ["seq"])


def append_ndjson(spark: SparkSession, df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def listing_stats(df: DataFrame) -> DataFrame:
    """One row: listings, sales, rents, others and share with coordinates."""
    n = F.count("*")
    side = lambda s: F.sum((F.coalesce(F.col("operation"), F.lit("")) == s).cast("bigint"))
    return df.agg(
        n.alias("total"),
        side("venta").alias("sales"),
        side("renta").alias("rents"),
        (n - side("venta") - side("renta")).alias("others"),
        half_up(F.sum(F.col("lat").isNotNull().cast("bigint")) * 100.0 / F.greatest(n, F.lit(1))).alias("geo_pct"),
    )


def write_listing_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def discover_datasets(files: DataFrame, pattern: str, companion: str, documents: DataFrame | None = None) -> DataFrame:
    """Datasets whose file matches ``pattern`` (one capture: the suffix) and whose companion file exists.

    ``files(path)`` is a listing; ``companion`` is a pattern with the same capture. Names come from
    ``documents(suffix, town, state)`` or from the suffix.
    """
    base = F.element_at(F.split("path", "/"), -1)
    named = files.select(F.regexp_extract(base, pattern, 1).alias("suffix")).filter("suffix <> ''").distinct()
    other = files.select(F.regexp_extract(base, companion, 1).alias("suffix")).filter("suffix <> ''")
    found = named.join(other, "suffix", "left_semi")
    fallback = text.title_case(F.regexp_replace("suffix", "_", " "))
    if documents is None:
        return found.select("suffix", fallback.alias("town"), F.lit("").alias("state")).orderBy("state", "town")
    j = found.join(documents, "suffix", "left")
    return j.select("suffix", F.coalesce("town", fallback).alias("town"), F.coalesce("state", F.lit("")).alias("state")).orderBy("state", "town", "suffix")


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """File listing without reading contents."""
    return spark.read.format("binaryFile").load(glob).select("path", "length")


# How contract columns are recognised in a normalised header. Per field its rules, best first: words
# that must occur, words that must not, and whether the first word is the whole header.
CONTRACT_FIELDS = {
    "kind": [(["tipo", "contrat"], [], False)],
    "contract_type": [(["contract_type"], [], True), (["tipo de contrato"], [], True)],
    "entity": [(["entidad federativa"], [], False), (["entidad"], ["compradora"], False)],
    "description": [(["descripcion"], [], False)],
    "title": [(["titulo", "contrat"], [], False), (["titulo"], [], False)],
    "agency": [(["siglas"], [], False), (["institucion"], [], False), (["dependencia"], [], False), (["proveedor"], [], False)],
    "start": [(["inicio"], [], False), (["firma"], [], False)],
    "currency": [(["moneda"], [], True)],
}
AMOUNT_WORDS = ("importe", "monto")
UNREADABLE = "\ufffd"


def normal_header(header: str) -> str:
    """Lower case without accents, surrounding blanks and a byte order mark."""
    import unicodedata

    plain = unicodedata.normalize("NFD", header.lstrip("\ufeff"))
    return re.sub(r"[\u0300-\u036f]", "", plain).strip().lower()


def bind_columns(headers: list[str], fields: dict[str, list]) -> dict[str, str | None]:
    """For each field the header that meets its best rule, the first of several; none if no rule is met."""

    def met(rule, name: str) -> bool:
        words, without, whole = rule
        return (name == words[0] if whole else all(w in name for w in words)) and not any(w in name for w in without)

    names = [normal_header(h) for h in headers]
    hits = {f: [(r, i) for r, rule in enumerate(rules) for i, n in enumerate(names) if met(rule, n)] for f, rules in fields.items()}
    return {f: headers[min(found)[1]] if found else None for f, found in hits.items()}


def amount_column(df: DataFrame, words: tuple = AMOUNT_WORDS) -> str | None:
    """The first column named like an amount in which at least half of all filled values are numbers (one aggregate)."""
    named = [h for h in df.columns if any(w in normal_header(h) for w in words)]
    if not named:
        return None
    value = lambda h: F.trim(F.coalesce(F.col(f"`{h}`"), F.lit("")))
    counts = [F.struct(F.count_if(value(h) != ""), F.count(text.amount(value(h)))).alias(str(i)) for i, h in enumerate(named)]
    shares = df.agg(*counts).first()
    return next((h for h, (filled, numbers) in zip(named, shares) if filled and 2 * numbers >= filled), None)


def readable(df: DataFrame) -> bool:
    """Whether the encoding fits: no replacement character in any header or row (one aggregate over all rows)."""
    if any(UNREADABLE in c for c in df.columns):
        return False
    line = F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns])
    return not df.agg(F.max(line.contains(UNREADABLE))).first()[0]


def scan_contracts(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """Contract export with unknown headers: the first encoding that fits header and rows, fields bound by name."""
    for encoding in encodings:
        df = spark.read.option("header", True).option("encoding", encoding).option("escape", '"').csv(path)
        if readable(df):
            break
    else:
        raise ValueError(f"none of the encodings {encodings} fits")
    bound = bind_columns(df.columns, CONTRACT_FIELDS) | {"amount": amount_column(df)}
    for either in (("kind", "contract_type"), ("entity", "description")):
        if not any(bound[f] for f in either):
            raise KeyError(f"no column for {' or '.join(either)}")
    return df.select(*[(F.col(f"`{h}`") if h else F.lit(None).cast("string")).alias(f) for f, h in bound.items()])


def upsert_history(history: DataFrame, run: DataFrame, keys: list[str]) -> DataFrame:
    """Append a run; the newest run wins per key. Both frames carry a ``run`` number."""
    return keep_last(history.unionByName(run), keys, ["run"])


def write_shards(df: DataFrame, path: str, zone: str = "zone") -> None:
    """One folder per zone slug. Rows of a large zone stay spread over several files."""
    shards = df.withColumn("zone_slug", text.slug(F.col(zone)))
    shards.write.mode("errorifexists").partitionBy("zone_slug").parquet(path)


def shard_index(spark: SparkSession, path: str, updated: str | None = None) -> DataFrame:
    """Listings per shard and the newest value of ``updated``."""
    df = spark.read.parquet(path)
    aggs = [F.count("*").alias("n")] + ([F.max(updated).alias("updated")] if updated else [])
    return df.groupBy("zone_slug").agg(*aggs)


def export_json(df: DataFrame, path: str, key: str) -> None:
    """One JSON document per row: ``{"key": ..., "value": {...}}``."""
    rest = [c for c in df.columns if c != key]
    df.select(F.to_json(F.struct(F.col(key).alias("key"), F.struct(*rest).alias("value"))).alias("value")).write.mode("errorifexists").text(path)
