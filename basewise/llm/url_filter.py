"""URL filters: rules by domain and path, else logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_az

#: Verdict, domain and path start.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
SIZES = (3, 4, 5)  # of the n-grams
FEATURES = 1 << 16
#: Words of hosts that are labelled, by what they stand for, and syllables of made-up hosts that are.
BAD = """
    casino casinos poker bet bets betting gamble gambler slots jackpot roulette blackjack bingo lottery wager bookie
    porn porno xxx sex adult escort escorts nude naked camgirls fetish erotic hookup sexy milf
    viagra cialis pills levitra tramadol xanax steroids fatburner dietpill cheapmeds
    payday-loan fastcash free-money cryptoprofit getrich giveaway freeprize bonuscode moneymaker forexsignals doubleyour
    warez crack cracked keygen torrent torrents nulled serialkeys malware phish phishing trojan spyware hacktool
    spam spam-farm clickbait link-farm backlinks buyfollowers replica rolexfake knockoff counterfeit adserver adtrack popunder tracker-pixel
""".split()
GOOD = """
    news wiki docs blog journal paper archive data library museum gallery theatre film books poetry dictionary language
    school university college course teacher student science physics biology chemistry math research history geography
    weather climate energy forest river mountain ocean garden farm recipes kitchen bread coffee restaurant hotel travel maps railway airport
    health hospital clinic doctor dental therapist family kids charity community council city government court police
    software code python linux database api support forum account login shop store market bank finance insurance jobs
    photo camera design furniture fashion watch clock bicycle cars sports football tennis chess music radio
    house window table chair apple lemon orange bridge island village street corner winter summer morning evening yellow silver
    letter number story picture voice people friend mother sister brother animal horse sheep rabbit flower leaf stone water
    engine machine factory workshop tools hardware electric signal network system service office meeting project report
    essex sussex alphabet better analyst pillow cracker scunthorpe classic cocktail sextant specialist
""".split()
SYLLABLES = "th he in er an re on at en nd ti es or ed st".split()
ZONES = "com net org biz info io co de shop xyz".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled URL table (1: block), made by rule: a few thousand rows.

    Both labels have the same zones, languages, schemes, fronts, endings and numbers, so only words tell them apart; every word stands alone, in front of and behind another, and in paths.
    """
    langs = ("en", "de", "fr", "es")
    n = len(SYLLABLES)
    made = [SYLLABLES[k % n] + SYLLABLES[(k * 3 + k // n) % n] + SYLLABLES[(k * 5 + 7 + k // n) % n] for k in range(8 * n)]
    rows = []
    for label, words in ((0, GOOD + made), (1, BAD)):
        for k, word in enumerate(words):
            other, plain = words[(7 * k + 3) % len(words)], made[(5 * k + label) % len(made)]
            hosts = [word, f"www.{word}", f"blog.{word}", f"m.{word}", f"best-{word}", f"online{word}", f"{word}-{other}", f"{word}{other}", f"my{word}24", f"free-{word}s", f"cheap-{word}"]
            for j, host in enumerate(hosts):
                zone = ZONES[(k + j) % len(ZONES)] if j % 2 else f"example.{ZONES[(k + j) % 3]}"
                path = f"/{langs[(k + j) % 4]}/{(37 * k + 211 * j) % 997}" + ("", ".html", "/", "?page=2", "#top")[(k + j) % 5]
                rows.append((f"http{'s' * (k % 2)}://{host}.{zone}{path}", label))
            for j in range(2):
                rows.append((f"http://{plain}.example.{ZONES[(k + j) % 3]}/{word}/{(43 * k + 97 * j) % 997}", label))
    return rows


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty if url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    return lower_az(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _grams(c: Column) -> Column:
    """The character n-grams of a text, as an array: what stands ahead of each character, the second halves of surrogate pairs excepted."""
    return F.concat(*[F.regexp_extract_all(c, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{n}}}))"), F.lit(1)) for n in SIZES])


def _with_grams(df: DataFrame, url: str) -> DataFrame:
    host, path = host_and_path(url)
    df = df.withColumns({"__host": host, "__path": path})
    line = df.withColumns({"__h": F.concat(F.lit("^"), "__host", F.lit("$")), "__p": F.concat(F.lit("^"), "__path", F.lit("$"))})
    marked = F.concat(F.transform(_grams(F.col("__h")), lambda g: F.concat(F.lit("h:"), g)), F.transform(_grams(F.col("__p")), lambda g: F.concat(F.lit("p:"), g)))
    return line.withColumn("__grams", marked).drop("__h", "__p")


def train(spark: SparkSession, labelled: list[tuple[str, int]] | None = None) -> PipelineModel:
    """Fit the classifier to a small labelled table of (url, 1 for block)."""
    rows = _with_grams(spark.createDataFrame(labelled or labelled_urls(), "url string, label int"), "url").coalesce(1).cache()
    tf = HashingTF(numFeatures=FEATURES, inputCol="__grams", outputCol="__tf", binary=True)
    unit = Normalizer(inputCol="__tf", outputCol="__features")
    fit = LogisticRegression(featuresCol="__features", regParam=0.00003, standardization=False, maxIter=60, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__block")
    model = PipelineModel([tf, unit, fit.fit(unit.transform(tf.transform(rows)))])
    rows.unpersist()
    return model


def matching_rule(host: str, path: str, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, the first among equals; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, domain, start in sorted(rules[::-1], key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == domain) | F.col(host).endswith("." + domain)) & F.col(path).startswith(start)
        text, verdict = F.when(fits, domain + start).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def judge_urls(pages: DataFrame, keep: list[str], url_col: str = "url", model: PipelineModel | None = None, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Return keep, host, path, rule, verdict and score (the model's probability of block) for every row.

    Neither clashing names of other columns (host, path, rule, verdict, score) nor nulls in them matter.  A null url, or one without `://`, has an empty host and path, fits no rule, and gets the model's
    verdict on empty text.  Repeated rows give repeated rows; an empty table gives none.  Rules are a
    short list that becomes one expression; everything runs in the JVM, without a shuffle.
    """
    model = model or train(pages.sparkSession)
    judged = model.transform(_with_grams(pages.select(*keep, F.col(url_col).alias("__url")), "__url"))
    rule, verdict = matching_rule("__host", "__path", RULES if rules is None else rules)
    own = F.when(F.col("__block") == 1, "block").otherwise("allow")
    return judged.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), vector_to_array("__p")[1].alias("score"))


def op8_query(pages: DataFrame) -> DataFrame:
    return judge_urls(pages, ["page_id"])
