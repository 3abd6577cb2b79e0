"""URL filter: allow and block rules, and for what they leave logistic regression on hashed character n-grams of host and path.

DataFrame functions and spark.ml (on the JVM) only. The regression is trained on a
small labelled table of urls; its weights travel with the model's transformation.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 1 << 15
#: More rules than this belong into a table that is joined by host suffix.
MAX_RULES = 1000
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
RESULTS = ("host", "path", "rule", "score", "verdict")
#: Words of which the default labelled table makes names: of unwanted pages, of wanted ones, and syllables of other names.
BAD_WORDS = "casino poker bet bets jackpot slots pills pharma adult porn xxx escort sexy spam click ads track popup replica loan payday cash crypto warez crack win winner prize cheap free hot bonus farm diet".split()
GOOD_WORDS = "library news weather university recipes history museum school science garden travel music art health sport forum wiki docs health city village river mountain bakery clinic theatre archive journal research code".split()
SYLLABLES = "ka le mi ro su ta ne vo di pa the re on in st ha ing er an ti ou th es ed".split()
BAD_PATHS = ("/promo/{n}", "/win-now/{n}.html", "/buy/cheap-{n}", "/click?id={n}", "/bonus/", "/free/download-{n}.exe", "/en/{n}", "/{n}.html", "")
GOOD_PATHS = ("/articles/{n}", "/about.html", "/wiki/page-{n}", "/2021/05/{n}", "/en/{n}", "/de/{n}/", "/fr/{n}.html", "/{n}.html", "")
SUFFIXES = ("com", "net", "org", "example.com", "example.net", "example.org")
FRONTS = ("", "www.", "m.", "blog.")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ://."""
    url = url.cast("string")
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def grams(host: Column, path: Column) -> Column:
    """All 3-, 4- and 5-grams of host and path, with marks at both ends; those of the path carry a mark of their own."""

    def of(text: Column, tag: str, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.lit(tag), F.substring(text, i, F.lit(n))))

    texts = ((F.concat(F.lit("^"), host, F.lit("$")), "h"), (F.concat(path, F.lit("$")), "p"))
    return F.concat(*[of(text, tag, n) for text, tag in texts for n in (3, 4, 5)])


def labelled(spark: SparkSession) -> DataFrame:
    """The default labelled table: url, bad (0 or 1), by rules from the word lists above, some three wanted for each unwanted one."""

    def urls(names: list[str], paths: tuple[str, ...], step: int) -> list[str]:
        return [f"http{'s' * (i % 2)}://{FRONTS[i * step % len(FRONTS)]}{name}.{SUFFIXES[i * 5 % len(SUFFIXES)]}{paths[i * step % len(paths)].format(n=i * 37 % 9973)}" for i, name in enumerate(names)]

    def pairs(words: list[str], every: int) -> list[str]:
        return [f"{a}{'-' if (i + j) % 4 else ''}{b}" for i, a in enumerate(words) for j, b in enumerate(words) if i != j and (i * 2 + j) % every == 0]

    made = len(SYLLABLES)
    other = [SYLLABLES[i % made] + SYLLABLES[(i * 7 + 3) % made] + (SYLLABLES[(i * 5 + i // made) % made] if i % 3 else "") for i in range(1000)]
    mixed = [f"{SYLLABLES[(i * 11) % made]}{SYLLABLES[(i * 3 + 1) % made]}-{w}" for i, w in enumerate(GOOD_WORDS * 2)]
    good = urls([*GOOD_WORDS, *pairs(GOOD_WORDS, 5), *other, *mixed], GOOD_PATHS, 7)
    rows = [(u, 1.0) for u in urls([*BAD_WORDS, *pairs(BAD_WORDS, 3)], BAD_PATHS, 5)] + [(u, 0.0) for u in good]
    return spark.createDataFrame(rows, "url string, bad double")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A labelled table from a CSV file with the columns url and bad (0 or 1)."""
    return spark.read.csv(path, header=True, schema="url string, bad double")


def train(labels: DataFrame) -> PipelineModel | None:
    """The regression of a small table (url, bad); None without both classes."""
    host, path = split_url(F.col("url"))
    rows = labels.where("bad is not null").select(F.col("bad").cast("double").alias("label"), grams(host, path).alias("grams")).coalesce(1).cache()
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    weight = F.when(F.col("label") == 1.0, (sizes.get(0.0, 1) / sizes.get(1.0, 1)) ** 0.5).otherwise(1.0)  # the rarer class weighs more, but not as much as the other
    steps = [HashingTF(numFeatures=DIMS, inputCol="grams", outputCol="features"), LogisticRegression(maxIter=60, regParam=0.003, standardization=False, weightCol="weight")]
    model = Pipeline(stages=steps).fit(rows.withColumn("weight", weight))
    rows.unpersist()
    return model


def apply_rules(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page (all other columns of ``pages``), host, path, rule and act (the rule's action) of every row (see judge)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    host, path = split_url(F.col("url"))
    out = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in RESULTS]).alias("page"), host.alias("host"), path.alias("path"))
    rule = act = F.lit(None).cast("string")
    for action, pattern in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = pattern.partition("/")
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))) & F.startswith(F.col("path"), F.lit(slash + rest))
        rule, act = F.when(fits, F.lit(pattern)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(act)
    return out.withColumn("rule", rule).withColumn("act", act)


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds host, path, rule, score and verdict (allow or block) to every row of ``pages`` (url).

    A rule ``host/path`` fits its host and all subdomains if the url's path starts
    with the rule's; the longest wins, of equally long ones the first. Without one
    the verdict is the regression's: block if the score (probability) is over 0.5;
    without a regression (see train) the score is 0. Null urls and those without ://
    have empty host and path. All other columns of ``pages`` stay, but those with
    these names; rows and repeats are kept.
    """
    out, model = apply_rules(pages, rules), train(labels)
    if model is None:
        out = out.withColumn("score", F.lit(0.0))
    else:
        out = model.transform(out.withColumn("grams", grams(F.col("host"), F.col("path")))).withColumn("score", vector_to_array("probability")[1])
    out = out.withColumn("verdict", F.coalesce("act", F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))))
    return out.select(*[F.col("page").getField(c).alias(c) for c in pages.columns if c not in RESULTS], *RESULTS)


def op8_query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, labelled(spark)).select("page_id", "host", "path", "rule", "verdict", "score")


def rules_query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """What of op8 SQL can express: host, path and rule."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return apply_rules(pages).select("page.page_id", "host", "path", "rule")


SQL = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
FROM h
"""
