"""URL filters: host and path rules, then a blocked Bloom filter of listed URLs before an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.llm.common import fold, pick

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
#: Query parameters that do not change the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="
#: (verdict, host, path); a rule fits its host and all hosts below it.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
WORDS = 8  # 64-bit words in a block; each listed URL sets one bit in every word of its block


def part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, group), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z folded; empty without ://."""
    return fold(part(url, 1))


def path_of(url: Column) -> Column:
    return part(url, 2)


def canonical(url: Column) -> Column:
    """Host without a leading www., path without slashes at its end, and the other query parameters in order."""
    kept = F.filter(F.split(F.substring(part(url, 3), 2, 1 << 30), "&", -1), lambda p: ~p.rlike(TRACKING) & (p != ""))
    query = F.array_join(F.array_sort(kept), "&")
    host, path = F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def masks(key: Column) -> list[Column]:
    """One bit for each word of the block, by six bits of a second hash."""
    second = F.xxhash64(F.lit(1), key)
    one = F.lit(1).cast("bigint")
    return [
        F.call_function("shiftleft", one, F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)
    ]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row with the filter: an array of ``blocks`` arrays of 64-bit words. Its size does not depend on the list."""
    bits = keys.select(block_of(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks(F.col("key")))])
    words = bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    filled = every.join(words, "block", "left").select(
        F.struct("block", F.array(*[F.coalesce(F.col(f"w{i}"), F.lit(0).cast("bigint")) for i in range(WORDS)]).alias("words")).alias("b")
    )
    return filled.agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["words"]).alias("filter"))


def may_hold(bloom: Column, key: Column, blocks: int) -> Column:
    words = F.get(bloom, block_of(key, blocks))
    out = F.lit(True)
    for i, mask in enumerate(masks(key)):
        out = out & (F.get(words, F.lit(i)).bitwiseAND(mask) != 0)
    return out


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, id_col: str = "page_id",
    url_col: str = "url", listed_col: str = "url", blocks: int = 4096,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule (or null), canonical and verdict (allow or block).

    The longest rule decides. Without one, a page is blocked if its canonical URL is that of a listed URL: a blocked
    Bloom filter of the list (``blocks`` times 512 bits, whatever the list's length) lets possible hits through to an
    exact hash join, which removes the false ones; all other pages are not shuffled. A list too long for the filter
    only sends more pages to the join.

    A null URL or one without :// has an empty host and path, fits no rule and no listed URL, and is allowed. Null ids
    and repeated rows are judged row by row; other columns are ignored. An empty table or list is allowed, and a URL may
    have any length.
    """
    url = F.col("url")
    rows = pick(pages, page_id=id_col, url=url_col).select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key")
    )
    rows = rows.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    listing = pick(listed, url=listed_col).select(canonical(url).alias("key")).where("key <> ''").distinct()
    bloom = bloom_filter(listing, blocks).scalar()
    open_row = F.col("by").isNull() & (F.col("host") != "")
    judged = rows.withColumn("maybe", F.when(open_row, may_hold(bloom, F.col("key"), blocks)).otherwise(F.lit(False)))
    hits = judged.where("maybe").join(listing.withColumn("found", F.lit(True)).hint("shuffle_hash"), "key", "left")
    out = [F.col("page_id"), F.col("host"), F.col("path"), F.col("by.rule").alias("rule"), F.col("key").alias("canonical")]
    return hits.select(*out, F.when(F.col("found"), "block").otherwise("allow").alias("verdict")).union(
        judged.where(~F.col("maybe")).select(*out, F.coalesce("by.verdict", F.lit("allow")).alias("verdict"))
    )
