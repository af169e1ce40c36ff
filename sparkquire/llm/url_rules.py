"""URL verdicts: given host and path rules first, then association rules mined by FP-growth, matched by an inverted index.

Everything here is DataFrame operations and Spark's own FP-growth; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: (verdict, host, path): a rule fits its host and all subdomains when the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, LEAST, CONFIDENCE = 0.001, 10, 0.8
LABELLED = 200_000
#: Rows of the index that go out in one broadcast, a few MB.
BLOCK = 50_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fits, domain + prefix).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels and their words, every path part that has letters and its words, ending, query keys, query values and their words. Numbers are left out."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    words = F.flatten(F.transform(labels, lambda x: F.split(x, r"[-_]+")))
    named = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    lettered = lambda xs: F.filter(F.transform(xs, F.lower), lambda x: x.rlike(r"\p{L}"))
    parted = lambda xs: F.concat(lettered(xs), F.flatten(F.transform(lettered(xs), lambda x: F.split(x, r"[^\p{L}\p{M}\p{N}]+"))))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.regexp_extract_all(query, F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    values = F.regexp_extract_all(query, F.lit(r"(?:^|&)[^=&]*=([^&]+)"), F.lit(1))
    given = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))), F.concat(F.lit("end:"), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)))),
        named("label:", labels), named("word:", words), named("path:", parted(F.split(path, "/"))), named("key:", keys), named("value:", parted(values)),
    )
    return F.array_distinct(F.filter(given, lambda t: ~t.rlike(r":\d*$")))


def labelled(pages: DataFrame, labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """url, unwanted: the first ``rows`` labelled URLs by a hash. A page carries the number of its document at the end of its path.

    Unwanted: its document is labelled toxic or of low quality. Labels are all that rules are learned from.
    """
    number = F.expr("try_cast(regexp_extract(quire_path, '/([0-9]+)/?(?:[.][A-Za-z0-9]+)?$', 1) as bigint)")
    keyed = pages.select("url").where("url is not null").withColumn("quire_path", path_of(F.col("url"))).select("url", number.alias("doc_id")).where("doc_id is not null")
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).cast("int")).alias("bad"))
    return keyed.join(bad, "doc_id").orderBy(F.xxhash64("url"), "url", "bad").limit(rows).select("url", (F.col("bad") == 1).alias("unwanted"))


def mined(labelled_urls: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """rule, items, confidence, support of the association rules whose consequent is the unwanted label.

    A rule needs a share of ``support`` of the labelled URLs and at least ``least`` of them, so
    that a small table gives no chance rules. Rules of any length and number stay, but for those that
    another rule of one token less makes needless, as it has no less confidence.
    """
    item = F.when(F.col("unwanted"), F.array(F.lit("label=unwanted"))).otherwise(F.array().cast("array<string>"))
    baskets = labelled_urls.select(F.concat(tokens(F.col("url")), item).alias("items")).where(F.size("items") > 0)
    share = min(1.0, max(support, least / max(baskets.count(), 1)))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence, numPartitions=int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
    found = (
        model.associationRules.where((F.element_at("consequent", 1) == "label=unwanted") & (F.col("lift") > 1))
        .select(F.sort_array("antecedent").alias("items"), "confidence", "support").withColumn("rule", F.array_join("items", " "))
    )
    subs = F.transform("items", lambda x: F.array_join(F.array_remove("items", x), " "))
    shorter = found.where(F.size("items") > 1).select("rule", "confidence", F.explode(subs).alias("sub")).join(found.select(F.col("rule").alias("sub"), F.col("confidence").alias("had")), "sub").where("had >= confidence").select("rule").distinct()
    return found.join(shorter, "rule", "left_anti")


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of every row of ``pages``.

    Rules are mined from labels alone; where those say nothing about URLs, none is, and the given rules alone decide.
    A given rule decides where one fits; of several the longest. Otherwise the
    page is blocked when all tokens of a mined rule are among its URL's tokens: an
    inverted index from token to rules, and a rule fires when as many tokens
    matched as it has. mined_rule is the surest of those, of equally sure ones the shortest, null where none fires. Matching is by distinct sets of tokens, so hosts that fill the
    table are matched once; the index goes out in blocks of ``block`` rows. Null URLs and those without ``://`` have an empty host and path and are
    allowed unless a given rule says otherwise. Repeated rows are judged one by one, URLs of any length whole. Without labels no rules are mined; without
    pages the result is empty. Other columns are not read.
    """
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = checkpointed(urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), F.when(verdict.isNull(), F.sort_array(tokens(F.col("url")))).alias("tokens")))
    train = labelled(pages, labels, how.pop("rows", LABELLED))
    block = how.pop("block", BLOCK)
    index = checkpointed(mined(train, **how).select("rule", "confidence", F.size("items").alias("need"), F.explode("items").alias("token")))
    blocks = max(1, -(-index.count() // block))
    sets = checkpointed(urls.where("given is null").select("tokens").distinct())
    fired = None
    for k in range(blocks):
        part = index.where(F.pmod(F.xxhash64("rule"), F.lit(blocks)) == k)
        hits = sets.select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(part), "token")
        some = hits.groupBy("tokens", "rule", "confidence", "need").agg(F.count("*").alias("got")).where("got = need").select("tokens", "rule", "confidence", "need")
        fired = some if fired is None else fired.unionByName(some)
    fired = fired.groupBy("tokens").agg(F.min_by("rule", F.struct(-F.col("confidence"), "need", "rule")).alias("mined_rule"))
    judged_sets = checkpointed(sets.join(fired, "tokens", "left"))
    plain = F.lit(None).cast("string").alias("mined_rule")
    out = urls.where("given is null").join(judged_sets, "tokens").unionByName(urls.where("given is not null").select("*", plain))
    method = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "mined_rule")
