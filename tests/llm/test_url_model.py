"""The URL classifier: its n-grams by brute force, and hosts of words and word forms that the labelled table does not hold."""

import re

import pytest
from basewise.llm import url_filter
from pyspark.sql import functions as F

BAD = """
    megacasino777.biz hotbingo-hall.net pokernight-cash.org sportsbetting-tips.info pornstars.xyz camgirl-live.net adultfriends.biz nudes.info viagraonline.shop
    steroid-store.biz paydayloans.us keygenerator-warez.net cracks4free.org torrentking.io malware-drop.ru phishingkit.cc spammers-paradise.com backlink-seller.biz
    jackpotcity.info lotterywinners.org
""".split()
GOOD = """
    gardening-club.us biologyclass.org bikerepair.net carpenter.biz lakeview-hotel.info newspapers.io daycare-center.org mathematics.cc opera-tickets.com vegetables.biz
    airports.info historians.org veterinary.net sailing-school.us cheese-makers.org democracy.io folkdance.net librarians.biz geology.xyz swimming.info
""".split()


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.train(spark)


def test_grams(spark):
    """Every n-gram of host and path, ends marked, repeats included."""
    urls = ["http://Ab.example.com/en/7?x", "https://a", "x://", "http://\U0001F600é\U0001F601.com/\n\U0001F602", None, "none"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    for r in url_filter._with_grams(rows, "u").collect():
        m = re.match(r".*?://([^/?#]*)([^?#]*)", r.u or "")
        parts = (("h:", f"^{m[1].lower() if m else ''}$"), ("p:", f"^{m[2] if m else ''}$"))
        assert sorted(r["__grams"]) == sorted(k + x[i : i + n] for k, x in parts for n in url_filter.SIZES for i in range(len(x) - n + 1)), r.u


def test_unseen_words(spark, model):
    known = {h for u, _ in url_filter.labelled_urls() for h in [u.split("/")[2]]}
    assert not known & {*BAD, *GOOD}
    rows = spark.createDataFrame([(k, f"https://{h}/{k % 7}") for k, h in enumerate(BAD + GOOD)], "page_id long, url string")
    got = {r.page_id: r.verdict == "block" for r in url_filter.judge_urls(rows, ["page_id"], model=model, rules=[]).collect()}
    caught, kept = sum(got[k] for k in range(len(BAD))), sum(not got[len(BAD) + k] for k in range(len(GOOD)))
    print("caught", caught, "kept", kept, [h for k, h in enumerate(BAD + GOOD) if got[k] != (k < len(BAD))])
    assert caught >= 15 and kept >= 15


def test_clashing_columns_and_repeats(spark, model):
    rows = [(1, "http://casino.example.com/de/1"), (1, "http://casino.example.com/de/1"), (None, None), (2, "http://" + "a" * 50_000 + ".com/" + "b" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(None).cast("int") for c in ("host", "path", "rule", "verdict", "score")})
    got = url_filter.judge_urls(pages, ["page_id"], model=model).orderBy("page_id").collect()
    assert [r.page_id for r in got] == [None, 1, 1, 2]
    assert (got[0].host, got[0].path, got[0].rule) == ("", "", None) and got[1] == got[2] and got[1].verdict == "block"
    assert len(got[3].host) == 50_004 and len(got[3].path) == 50_001
