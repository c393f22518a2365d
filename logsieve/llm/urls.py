"""URL filter: host/path rules first, then logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table.

Everything is DataFrame / SQL expressions. Training runs in the dual: with all
weights starting at zero, gradient descent keeps w = sum_i alpha_i x_i, so the
loop only updates one coefficient per labelled URL through the (n x n) product
matrix of their feature vectors. The learned weights are one array of
``buckets`` doubles (fixed size, independent of the data), put into the scoring
projection as a constant; the scan of the pages is a single narrow stage.

Defined results: a null url or one without ``://`` has empty host and path and
is judged by the model's bias alone; repeated rows get the same verdict; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default rules: (verdict, host/path prefix).
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)

# Default training table: a site name and whether its pages are worth keeping (1)
# or not (0). Each name is written with several sub-domains, endings and paths,
# the same ones for either label, so that only names can tell them apart.
GOOD_SITES = (
    "riverside-news", "gardening", "hillwalker", "toolkit-docs", "openlexicon", "physics-notes", "village-kitchen",
    "dailypaper", "bronze-museum", "medicine-journal", "schoolbooks", "travelnotes", "bookclub", "woodwork",
    "weather-station", "townhall", "essays", "chess-lessons", "songbirds", "python-course", "cyclist", "foxtales",
    "the-library", "history-of-art", "university", "thenora", "anerthe", "lamere", "verein", "cionado", "thonest",
    "theander",
)
BAD_SITES = (
    "casino-bonus", "ads-server", "adserver", "ad-track", "web-tracker", "spam-links", "spamfarm", "link-farm",
    "cheap-meds", "pills-online", "adult-videos", "xxx-tube", "free-spins", "bets-online", "sports-betting", "bet-win",
    "porn-cams", "poker-win", "win-prizes", "fast-loans", "click-farm", "pop-ads", "cheap-watches", "cheap-pharma",
    "adult-dating", "warez-crack", "free-keygen", "payday-cash", "seo-spam", "casino-slots", "free-bets", "track-clicks",
)
_SUBS = ("", "www.", "blog.", "m.")
_ENDS = ("com", "org", "net")
_PATHS = ("/en/12", "/fr/7.html", "/de/345/", "/es/81?page=2&ref=x", "/en/9#top", "/news/2021/04", "/")


def site_urls(sites, label: int, each: int = 2) -> list[tuple[str, int]]:
    """``each`` urls of every site, going round the sub-domains, endings, paths."""
    return [(f"https://{_SUBS[k % 4]}{site}.example.{_ENDS[k % 3]}{_PATHS[k % 7]}", label)
            for i, site in enumerate(sites) for k in (i + 5 * j for j in range(each))]


LABELLED_URLS = (*site_urls(GOOD_SITES, 1), *site_urls(BAD_SITES, 0))
BUCKETS = 4096
GRAMS = (3, 4)
EPOCHS = 200
RATE = 10.0
L2 = 0.001

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def matching_rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, nulls if none does."""
    rule = verdict = None
    for say, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = text.index("/")
        fits = ((host_ == text[:at]) | host_.endswith("." + text[:at])) & path_.startswith(text[at:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def buckets(host_: str, path_: str, sizes=GRAMS, width: int = BUCKETS) -> Column:
    """array<int>: the bucket of every n-gram of ``^host$`` and ``^path$`` (host
    and path hash apart). Characters are split once, so the work is linear in
    the length of the url."""
    parts = []
    for column, mark in ((host_, "h"), (path_, "p")):
        for n in sizes:
            chars = f"filter(split(concat('^', {column}, '$'), ''), c -> c <> '')"
            gram = ", ".join(f"cs[i + {k}]" for k in range(n))
            parts.append(
                f"flatten(transform(array({chars}), cs -> transform("
                f"IF(size(cs) >= {n}, sequence(0, size(cs) - {n}), array()), "
                f"i -> cast(pmod(xxhash64('{mark}', {gram}), {width}) as int))))"
            )
    return F.expr(f"concat({', '.join(parts)})")


def train(spark: SparkSession, labelled=LABELLED_URLS, epochs: int = EPOCHS, rate: float = RATE,
          l2: float = L2) -> tuple[list[float], float]:
    """(weights by bucket, bias) by full-batch gradient descent on the logistic
    loss with an L2 penalty, over the unit-length count vectors of the urls."""
    rows = [(i, u, float(y)) for i, (u, y) in enumerate(labelled)]
    urls = spark.createDataFrame(rows, "i int, url string, y double").coalesce(1)
    parts = urls.select("i", "y", host(F.col("url")).alias("h"), path(F.col("url")).alias("p"))
    counts = (parts.select("i", "y", F.explode(buckets("h", "p")).alias("b"))
              .groupBy("i", "y", "b").agg(F.count("*").cast("double").alias("n")))
    norms = counts.groupBy("i").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    x = counts.join(norms, "i").select("i", "y", "b", (F.col("n") / F.col("norm")).alias("v"))
    other = x.select(F.col("i").alias("j"), "b", F.col("v").alias("u"))
    # the training table is small and fixed, so is its product matrix
    products = x.join(other, "b").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("u")).alias("k"))
    lines = (urls.select(F.col("i"), "y").join(
        products.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "k"))).alias("ks")), "i")
        .agg(F.array_sort(F.collect_list(F.struct("i", "y", "ks"))).alias("m")))
    n = len(rows)
    step = (
        "struct("
        "transform(s.f, (f, i) -> s.a[i] + {r} * ((m[i].y - 1 / (1 + exp(-f))) / {n} - {l2} * s.a[i])) as a,"
        " s.b + {r} * aggregate(zip_with(s.f, m, (f, e) -> (e.y - 1 / (1 + exp(-f))) / {n}),"
        " 0D, (t, v) -> t + v) as b)"
    ).format(r=repr(rate), n=n, l2=repr(l2))
    # the row's product with alpha: sparse, as rows without common n-grams are absent
    scores = ("transform(m, e -> q.b + aggregate(e.ks, 0D, (t, z) -> t + z.k * q.a[z.j]))")
    zero = f"array_repeat(0D, {n})"
    loop = (
        f"aggregate(sequence(1, {epochs}), struct({zero} as a, 0D as b, {zero} as f), "
        f"(s, t) -> transform(array({step}), q -> struct(q.a as a, q.b as b, {scores} as f))[0])"
    )
    fitted = lines.select(F.expr(loop).alias("s"))
    alphas = fitted.select(F.posexplode("s.a").alias("i", "alpha"))
    weights = (x.join(alphas, "i").groupBy("b").agg(F.sum(F.col("v") * F.col("alpha")).alias("w"))
               .unionByName(fitted.select(F.lit(-1).alias("b"), F.col("s.b").alias("w"))))
    learned = {r.b: r.w for r in weights.collect()}  # at most BUCKETS + 1 rows
    return [learned.get(b, 0.0) for b in range(BUCKETS)], learned[-1]


def score(host_: str, path_: str, model: tuple[list[float], float]) -> Column:
    """Probability that the url is worth keeping; unit-length count vectors."""
    weights, bias = model
    table = "cast(split('" + ",".join(f"{w:.9g}" for w in weights) + "', ',') as array<double>)"
    found = F.array_sort(buckets(host_, path_))
    dot = F.aggregate(found, F.lit(0.0), lambda t, b: t + F.get(F.expr(table), b))
    # length of the count vector: runs of equal buckets in the sorted list
    runs = F.aggregate(
        found,
        F.struct(F.lit(-1).alias("b"), F.lit(0.0).alias("n"), F.lit(0.0).alias("q")),
        lambda s, b: F.when(
            s["b"] == b, F.struct(b.alias("b"), (s["n"] + 1.0).alias("n"),
                                  (s["q"] + 2.0 * s["n"] + 1.0).alias("q"))
        ).otherwise(F.struct(b.alias("b"), F.lit(1.0).alias("n"), (s["q"] + 1.0).alias("q"))),
        lambda s: F.sqrt(F.greatest(s["q"], F.lit(1.0))))
    return 1.0 / (1.0 + F.exp(-(bias + dot / runs)))


def judge_urls(pages: DataFrame, rules=RULES, labelled=LABELLED_URLS, url: str = "url",
               model: tuple[list[float], float] | None = None) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict."""
    model = model or train(pages.sparkSession, labelled)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    parts = pages.select(*kept, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rule, say = matching_rule(F.col("host"), F.col("path"), rules)
    return (parts.withColumn("score", score("host", "path", model))
            .select(*kept, "host", "path", rule.alias("rule"), "score",
                    F.coalesce(say, F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict")))
