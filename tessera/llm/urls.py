"""URL filters: nested host-and-path rules by a sort-merge range join over reversed hosts.

A host's key is its labels reversed, each ended by U+0001 (com.example.www. in that sense), so a rule's host
and all its subdomains are one interval of keys and rules' intervals nest. Urls are dealt into ranges of keys, a
rule into every range that its interval meets; within a range a sweep over rules and urls in key order keeps a
stack of the active rules. The rule that holds is the longest active one whose path starts the url's: longest
host first, then longest path.

Range bounds come from a sample of keys (near `per_range` for each range, and at most SAMPLE however many pages and
ranges there are) and only deal out work; a host with many urls fills several equal bounds, and its urls spread over
those ranges by a hash of their id.

Defined results: a null url, or one without "://", has an empty host and path and the default verdict; urls and
ids may repeat; of rules with the same host and path the one that comes first in (host, path, verdict) holds; an
empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import partitions, quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\x01"
#: The most keys that reach the driver.
SAMPLE = 1 << 18
OUT = "page_id long, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lowered."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each with an end mark; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), END), F.lit(END)))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", per_range: int = 100) -> DataFrame:
    """One row for each page: page_id, host, path, rule (host and path, or null), verdict.

    rules: host, path, verdict; a path starts with / or is empty.
    """
    spark = pages.sparkSession
    n = partitions(spark)
    url = quoted(url_col)
    keyed = pages.select(quoted(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("key", reversed_host(F.col("host")))
    total = pages.count()
    wanted = min(per_range * n, SAMPLE // 2)
    sample = keyed.select("key").sample(min(1.0, wanted / max(total, 1)), seed=7).limit(2 * wanted)
    keys = sorted(r["key"] for r in sample.collect())
    bounds = [keys[i * len(keys) // n] for i in range(1, n)] if keys else []

    def places(key: pd.Series, salt: pd.Series) -> pd.Series:
        low = np.array([bisect_left(bounds, k) for k in key], dtype="int64")
        high = np.array([bisect_right(bounds, k) for k in key], dtype="int64")
        return pd.Series((low + salt.to_numpy("int64") % (high - low + 1)).astype("int32"))

    def spans(low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(bounds, a), bisect_right(bounds, b) + 1)) for a, b in zip(low, high, strict=True)])

    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 30))
    urls = keyed.select(F.pandas_udf(places, "int")("key", salt).alias("part"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    known = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null").withColumn("key", reversed_host(F.col("host")))
    dealt = known.withColumn("part", F.explode(F.pandas_udf(spans, "array<int>")("key", F.concat("key", F.lit("\U0010ffff")))))
    both = urls.unionByName(dealt.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict"))
    swept = both.repartition(n, "part").sortWithinPartitions("part", "key", "kind", "host", "path", "verdict")
    return swept.mapInArrow(_sweep(default), OUT)


def _sweep(default: str):
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []  # the stack: key and [(path, rule, verdict)], outer hosts first
        for batch in batches:
            out = []
            for at, key, kind, page_id, host, path, verdict in zip(*[batch[c].to_pylist() for c in ("part", "key", "kind", "page_id", "host", "path", "verdict")], strict=True):
                if at != part:
                    part, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((path, host + path, verdict))
                    continue
                best = None
                for _, rules in reversed(stack):
                    fits = [r for r in rules if path.startswith(r[0])]
                    if fits:
                        best = max(fits, key=lambda r: len(r[0]))
                        break
                out.append((page_id, host, path, best and best[1], best[2] if best else default))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run
