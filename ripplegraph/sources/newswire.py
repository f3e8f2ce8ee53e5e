"""News records as tab-separated lines of 27 columns, also in zipped slices: readers and the typed form."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = 27
# Places of the fields in the public record format.
PLACES = {"record_id": 0, "published": 1, "kind": 2, "domain": 3, "url": 4, "themes": 7, "v2themes": 8, "orgs": 13, "v2orgs": 14, "tone": 15, "image": 18, "amounts": 24, "translation": 25, "extras": 26}


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """The lines of every member of the zip files at `path`, split at \\n alone, bad bytes replaced; one file a row, as slices are a few MB."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        yield pd.DataFrame({"line": [x for x in z.read(name).decode("utf-8", "replace").split("\n") if x]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "line string")


def _places(field: Column, last: str) -> Column:
    """`text,number;text,number` as an array of structs; entries without a number go."""
    parts = F.filter(F.split(field, ";"), lambda x: F.regexp_like(x, F.lit(r"^.+,\d+$")))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(.*),\d+$", 1).alias(last), F.regexp_extract(x, r",(\d+)$", 1).cast("int").alias("off")))


def parse_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed records; lines of fewer than 27 columns go, fields that don't parse are null or empty."""
    c = F.split(F.col(line), "\t", -1)
    f = {name: c[i] for name, i in PLACES.items()}
    ts = F.try_to_timestamp(f["published"], F.lit("yyyyMMddHHmmss"))
    tone = F.split(f["tone"], ",", -1)
    raw = F.filter(F.split(f["amounts"], ";"), lambda x: F.regexp_like(x, F.lit(r"^-?[\d.]+,[^,]*,\d+$")))
    amounts = F.transform(raw, lambda x: F.struct(F.split(x, ",")[0].try_cast("double").alias("value"), F.split(x, ",")[1].alias("object"), F.split(x, ",")[2].try_cast("int").alias("off")))
    plain = lambda name: F.filter(F.split(f[name], ";"), lambda x: x != "")
    return lines.where(F.size(c) >= COLUMNS).select(
        f["record_id"].alias("record_id"), ts.alias("published_ts"), F.to_date(ts).alias("published_at"), (f["kind"] == "1").alias("is_web"), (f["translation"] != "").alias("is_translingual"),
        f["domain"].alias("domain"), f["url"].alias("url"), plain("themes").alias("themes"), _places(f["v2themes"], "code").alias("v2themes"), plain("orgs").alias("orgs"), _places(f["v2orgs"], "name").alias("v2orgs"),
        F.get(tone, F.lit(0)).try_cast("double").alias("tone"), F.get(tone, F.lit(3)).try_cast("double").alias("polarity"), amounts.alias("amounts"),
        F.nullif(f["image"], F.lit("")).alias("sharing_image"), F.nullif(F.regexp_extract(f["extras"], "<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1), F.lit("")).alias("title"),
    )
