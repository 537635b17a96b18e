"""URL filters: rules on hosts and paths, and a blocked Bloom filter of listed URLs in front of an exact join.

Canonical form of a URL: host without port 80 or 443 and without a leading "www.", path without slashes at its end, query
without tracking parameters (their names in `TRACKING`) and with the others in order; scheme and fragment go. The filter
has blocks of 512 bits; a URL's hash names one block and `PROBES` bits in it. Blocks are built by Spark as rows of eight
64-bit words. Their number follows that of the listed URLs up to `MAX_BLOCKS` (16 MB), the proven bound under which the
filter is broadcast; a longer list only lets more URLs through to the exact join, which removes all false positives.

A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins and comes before the list.
Null URLs and those without "://" have empty host and path, fit no rule and are not listed. Repeated rows each get a verdict.
Other columns are carried along, whatever their names; those named like the four added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import ascii_lower, shelved
from assayline.session import settle

#: Fixed values of the contract: verdict and rule, host before the first slash and path from it.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="
PROBES = 8
BITS_PER_URL = 12
MAX_BLOCKS = 1 << 18


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(rest_of(url), "^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        top, slash, tail = rule.partition("/")
        fits = ((host == top) | F.endswith(host, F.lit("." + top))) & F.startswith(path, F.lit(slash + tail))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, say).otherwise(verdict)
    return name, verdict


def canonical(url: Column) -> Column:
    """Null where the URL has no "://"."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~x.rlike(TRACKING)))
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole)


def block_and_bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key and its PROBES bit numbers in it, nine bits each of a second hash and its rest."""
    h, g = F.xxhash64(F.lit("bits"), key), F.xxhash64(F.lit("more"), key)
    bits = [F.shiftrightunsigned(h if i < PROBES // 2 else g, 9 * (i % (PROBES // 2))).bitwiseAND(511).cast("int") for i in range(PROBES)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), F.array(*bits)


def bloom(listed: DataFrame) -> tuple[DataFrame, int]:
    """listed (url, canonical and distinct): (block, words), and the number of blocks."""
    blocks = min(MAX_BLOCKS, max(1, -(-listed.count() * BITS_PER_URL // 512)))
    block, bits = block_and_bits(F.col("url"), blocks)
    one = listed.select(block.alias("block"), F.explode(bits).alias("bit"))
    words = [F.bit_or(F.when(F.expr(f"bit div 64 = {i}"), F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(8)]
    return one.groupBy("block").agg(*words).select("block", F.array(*[f"w{i}" for i in range(8)]).alias("words")), blocks


def listed_keys(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct values of keys (url) that are in listed (url): Bloom filter first, then the exact join."""
    filter_rows, blocks = bloom(listed)
    block, bits = block_and_bits(F.col("url"), blocks)
    probes = keys.where("url is not null").select("url", block.alias("block"), bits.alias("bits"))
    hit = F.forall("bits", lambda b: F.shiftrightunsigned(F.get("words", F.floor(b / 64).cast("int")), 0).bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)))) != 0)
    possible = probes.join(F.broadcast(filter_rows), "block").where(hit).select("url")
    return possible.distinct().join(listed, "url", "left_semi")


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """All columns of `pages` with _host, _path, _rule and _verdict. listed: (url), any spelling."""
    listed = shelved(listed, ("url",))[0]
    pages, back = shelved(pages, ("url",), ("_host", "_path", "_rule", "_verdict"))
    names = settle(listed.select(canonical(F.col("url")).alias("url")).where("url is not null").distinct(), "listed")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    known = pages.withColumns({"_host": host, "_path": path, "_canonical": canonical(F.col("url"))})
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    known = known.withColumns({"_rule": rule, "_say": verdict})
    bad = listed_keys(known.where("_rule is null").select(F.col("_canonical").alias("url")), names).withColumnRenamed("url", "_bad")
    out = known.join(bad, known["_canonical"] == bad["_bad"], "left")
    says = F.coalesce("_say", F.when(F.col("_bad").isNotNull(), "block").otherwise("allow"))
    return out.select(*back, "_host", "_path", "_rule", says.alias("_verdict"))


def recrawled(pages: DataFrame) -> DataFrame:
    """(url): canonical URLs that two or more pages have, as a list made of the table itself."""
    one = pages.select(canonical(F.col("url")).alias("c")).where("c is not null").groupBy("c").count()
    return one.where("count > 1").select(F.concat(F.lit("http://"), "c").alias("url"))
