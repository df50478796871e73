"""URL filter: fixed rules, then logistic regression on hashed character n-grams.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased.  Path: from there up to ``?``, ``#`` or the end.  Without ``://``
(or url) both are empty.  A rule (host, path) fits its host and all subdomains
of it when the url's path starts with the rule's; the longest rule that fits
decides.  Urls without a rule get the model's verdict.

The model is learned on the driver from a small labelled table (some 200 urls,
the bound being the table passed in).  Scoring is native: character
n-grams of host and path are sliced, hashed and looked up in a constant array
by SQL functions; there is no join, no shuffle and no Python.

Defined cases: a null url has an empty host and path, fits no rule and gets the
verdict of the intercept; repeated rows are each judged; other columns ignored.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N = (3, 4)
BUCKETS = 4096
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


#: The labelled table, set by hand: urls of pages to keep and to block.  Hosts and paths differ by class in their words;
#: top-level domains and schemes do not.
KEEP = """
https://en.wikipedia.org/wiki/Photosynthesis https://www.gutenberg.org/ebooks/1342 https://arxiv.org/abs/1706.03762 https://www.nature.com/articles/d41586-020-00502-w
https://www.bbc.co.uk/news/science-environment-56837908 https://docs.python.org/3/library/json.html https://www.nasa.gov/missions/station/crew-returns/ https://www.loc.gov/collections/maps/about/
https://www.britannica.com/biography/Marie-Curie http://www.weather.gov/forecast/boston https://www.who.int/health-topics/malaria https://www.metmuseum.org/art/collection/search/436535
https://stackoverflow.com/questions/11227809/sorted-array http://plato.stanford.edu/entries/kant/ https://www.theguardian.com/books/2019/may/04/review-novel https://www.nps.gov/yell/planyourvisit/trails.htm
https://www.cs.cmu.edu/~teaching/lecture-notes/graphs.html https://developer.mozilla.org/en-US/docs/Web/HTML/Element/table https://www.kingarthurbaking.com/recipes/sourdough-bread-recipe https://www.ncbi.nlm.nih.gov/pmc/articles/PMC3531190/
https://www.oxfordreference.com/view/entry-on-grammar http://libraryguide.example.net/catalogue/history/ https://gardenjournal.example.com/2018/06/pruning-roses https://villagemuseum.example.org/visit/opening-hours
https://www.mathforum.example.com/lessons/fractions http://cityarchive.example.net/documents/1902/letters https://birdwatch.example.org/species/robin.html https://www.cyclingclub.example.com/routes/river-valley
http://m.schoolnews.example.com/2021/09/term-dates https://kitchen-notes.example.net/soup/leek-and-potato https://blog.mountainwalks.example.org/hut-to-hut http://www.parishrecords.example.com/baptisms/1841
https://geology-reading.example.com/minerals/quartz https://oldmaps.example.net/county/norfolk http://science.example.org/physics/optics/lenses https://www.choirpractice.example.com/scores/bach
https://choosing-telescopes.example.net/beginners http://languagelab.example.com/german/verbs https://history.example.net/romans/roads.html https://www.woodworker.example.org/joints/dovetail
http://poetrycorner.example.com/sonnets/18 https://chess.example.net/openings/italian https://blog.theatre.example.com/reviews/hamlet http://www.townhall.example.org/council/minutes/2017
https://statistics.example.com/regression/residuals https://railways.example.net/timetable/1955 http://knitting.example.org/patterns/scarf https://www.philosophers.example.com/essays/on-liberty
https://thenorthern.example.com/en/4821 http://www.ontheland.example.net/fr/77.html https://m.motion-studies.example.org/de/9310/ https://blog.intention.example.com/es/112
http://thather.example.org/en/640?page=2 https://www.whenthere.example.net/en/5120.html https://nation-and-town.example.com/fr/8 http://m.tenderness.example.net/de/3004
https://blog.shetland.example.com/en/771/ https://heathen.example.org/es/56.html http://www.thirteenth.example.net/en/9002#top https://reason.example.com/fr/415?utm_source=feed
https://m.anthem.example.net/de/1201 http://blog.handstand.example.org/en/33 https://wisdom.example.com/es/7009/ https://www.nortonhill.example.net/en/280.html
https://ednesday.example.com/de/610 http://singing.example.net/fr/2294/ https://m.ation.example.org/en/15 https://www.inherit.example.com/es/980.html
https://weatherstation.example.org/climate/rainfall http://www.lighthouse.example.net/keepers/diary https://observatory.example.com/comets/1910 https://blog.beekeeping.example.org/hives/winter
http://museum.example.net/exhibits/pottery https://www.seedlibrary.example.com/beans/heritage https://harbour.example.org/tides/march http://m.dialect.example.net/words/northern
https://orchard.example.com/apples/varieties https://www.clockmaker.example.net/pendulum http://folklore.example.org/tales/river https://blog.bookbinding.example.com/tools/awl
https://www.europeana.eu/en/collections/topic/80-fashion http://www.perseus.tufts.edu/hopper/collections https://www.rijksmuseum.nl/en/rijksstudio https://www.openstreetmap.org/about
https://www.usgs.gov/faqs/what-earthquake https://www.eff.org/deeplinks/2018/03/primer https://www.cern.ch/about/history https://www.folger.edu/explore/shakespeares-works/hamlet/
"""
BLOCK = """
http://cheap-pills-online.example.com/buy/viagra https://casino-bonus.example.net/slots/free-spins http://win-casino-now.example.org/jackpot?ref=aff12 https://xxx-tube.example.com/videos/hot
http://free-bets-today.example.net/odds/promo https://adult-cams.example.com/live/girls http://pills-shop.example.org/order/no-prescription https://spam-farm.example.net/links/page9
http://track-ads.example.com/click?id=8831 https://link-farm.example.org/out/99 http://hot-deals-x.example.com/replica-watches https://poker-win.example.net/join/bonus
http://xxx-video.example.org/porn/clip https://ads-track.example.com/pixel.gif?u=1 http://free-pills.example.net/cialis/cheap https://bets-now.example.com/signup/promo-code
http://casino.example.com/roulette/play https://www.best-casino-win.example.net/spins http://m.pills-discount.example.org/tramadol https://blog.spamlinks.example.com/backlinks/buy
http://sexcams.example.net/webcam https://payday-loans-fast.example.com/apply-now http://free-money.example.org/earn-cash-fast https://cheap-rolex-replica.example.net/shop
http://clickfarm.example.com/redirect?to=offer https://adserver.example.net/banner/728x90 http://popunder-ads.example.org/serve https://winprize.example.com/claim-your-prize
http://lottery-winner.example.net/claim https://hot-singles.example.com/dating/adult http://viagra-store.example.org/buy-now https://bitcoin-doubler.example.com/invest
http://slots-casino.example.net/en/77 https://poker-bets.example.com/fr/310.html http://adult-xxx.example.org/de/9 https://spam-links.example.net/es/640/
http://www.cheap-pills-now.example.com/en/3301 https://m.casino-free-bets.example.net/en/512.html http://blog.porn-video.example.org/es/88 https://track-click.example.com/en/4400?utm_source=feed
http://m.ads-banner.example.net/fr/17/ https://www.win-free-cash.example.com/de/2005 http://pills-pharmacy.example.net/en/61#top https://blog.adult-dating.example.com/es/7
http://link-exchange-farm.example.org/en/8086 https://betting-odds-win.example.net/de/43.html http://xxx-girls.example.com/fr/909 https://free-spins.example.org/en/5/
http://cheapmeds.example.com/order-pills https://casinos-royal.example.net/bonus-code http://escort-girls.example.org/city https://www.warez-crack.example.com/download/keygen
http://torrent-crack.example.net/serial-key https://loan-shark.example.com/fast-cash http://miracle-weight-loss.example.org/pills https://work-from-home-cash.example.net/join-now
http://fake-followers.example.com/buy-likes https://buy-backlinks.example.net/cheap-seo http://phish-login.example.org/verify-account https://secure-paypal-login.example.com/update
http://spin-win.example.net/jackpot https://megabets.example.com/live-odds http://sexshop.example.org/toys/hot https://webcam-xxx.example.net/free
http://pharma-cheap.example.com/cialis https://ad-click.example.org/go?aff=7 http://traffic-exchange.example.net/autosurf https://doorway-links.example.com/page/77
http://best-poker-bonus.example.org/play https://onlineslots.example.net/jackpots http://adultfinder.example.com/hookup https://cash-prize.example.org/winner
http://dirty-video.example.net/xxx/77 https://replica-bags.example.com/cheap-outlet http://bets.example.org/sports-betting https://hot-offers-ads.example.net/deal?clickid=3
http://www.pills24.example.com/viagra-generic https://blog.freecasino.example.net/no-deposit-bonus http://m.xxxcams.example.org/live https://clicktrack.example.com/r?u=55
http://spam.example.net/cheap https://links-farm.example.com/seo/backlink http://ads.example.org/track?cid=1 https://gamble-win.example.net/bet
http://porn.example.com/hd https://prizes-free.example.org/claim-now http://pill-mart.example.net/buy-cheap https://slots777.example.com/spin
"""


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: 1 for urls to block; in the order of a hash, so that classes and hosts are mixed."""
    rows = [(u, 0) for u in KEEP.split()] + [(u, 1) for u in BLOCK.split()]
    return sorted(rows, key=lambda r: hashlib.md5(r[0].encode()).hexdigest())


def holdout(folds: int = 5) -> float:
    """Share of the table's urls judged rightly by models that have not seen them (each fold in turn held out)."""
    rows, right = labelled_urls(), 0
    for f in range(folds):
        w, b = train([r for i, r in enumerate(rows) if i % folds != f])
        for u, y in rows[f::folds]:
            at = _buckets(*_parts(u))
            right += (b + sum(w[i] for i in at) / math.sqrt(max(len(at), 1)) > 0) == (y == 1)
    return right / len(rows)


def _parts(url: str) -> tuple[str, str]:
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def _buckets(host: str, path: str) -> list[int]:
    out = []
    for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in N:
            for i in range(len(s) - n + 1):
                out.append(int(hashlib.md5((mark + s[i : i + n]).encode()).hexdigest()[:3], 16))
    return out


def train(table: list[tuple[str, int]], epochs: int = 60, rate: float = 0.2, l2: float = 5e-3) -> tuple[list[float], float]:
    """Weights (rounded to 6 digits) and intercept by plain stochastic gradient steps."""
    rows = [(_buckets(*_parts(u)), y) for u, y in table]
    w, b = [0.0] * BUCKETS, 0.0
    for _ in range(epochs):
        for at, y in rows:
            scale = 1 / math.sqrt(max(len(at), 1))
            z = b + scale * sum(w[i] for i in at)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            b -= rate * g * 0.1
            for i in at:
                w[i] -= rate * (g * scale + l2 * w[i])
    return [round(x, 6) for x in w], round(b, 6)


def host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        at, _, rest = rule.partition("/")
        fits = ((h == at) | h.endswith(f".{at}")) & p.startswith(f"/{rest}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def logit(h: Column, p: Column, model: tuple[list[float], float]) -> Column:
    weights, intercept = model
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # folded to a constant

    def grams(mark: str, s: Column, n: int) -> Column:
        s = F.concat(F.lit("^"), s, F.lit("$"))
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.concat(F.lit(mark), F.substr(s, i, F.lit(n))))
        # Too short a string gives one gram shorter than n, which is left out.
        return F.filter(cut, lambda g: F.length(g) == n + 1)

    kept = F.concat(*(grams(mark, s, n) for n in N for mark, s in (("h", h), ("p", p))))
    values = F.transform(kept, lambda g: F.element_at(table, F.conv(F.substring(F.md5(g), 1, 3), 16, 10).cast("int") + 1))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return total / F.sqrt(F.greatest(F.size(kept), F.lit(1))) + F.lit(intercept)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, model=None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``; score is the model's probability of block."""
    model = model or train(labelled_urls())
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    z = logit(F.col("host"), F.col("path"), model)
    out = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), z.alias("z"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("z") > 0, "block").otherwise("allow")).alias("verdict"), (1 / (1 + F.exp(-F.col("z")))).alias("score"))


def oracle(model=None) -> str:
    """The same judgement in DuckDB's SQL."""
    weights, intercept = model or train(labelled_urls())
    whens = []
    for kind, rule in sorted(RULES, key=lambda r: -len(r[1])):
        at, _, rest = rule.partition("/")
        whens.append((f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}')", rule, kind))
    name = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in whens)
    kind = " ".join(f"WHEN {c} THEN '{k}'" for c, _, k in whens)
    grams = " || ".join(f"list_transform(range(1, greatest(length({s}) + 2 - {n - 1} + 1, 1)::BIGINT), lambda i: '{m}' || substr('^' || {s} || '$', i::INT, {n}))" for n in N for m, s in (("h", "host"), ("p", "path")))
    return f"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
w AS (SELECT {json.dumps(weights)}::DOUBLE[] AS w),
grams AS (SELECT page_id, host, path, {grams} AS g FROM parts),
scored AS (
  SELECT page_id, host, path,
    list_sum(list_transform(g, lambda x: w.w[('0x' || substr(md5(x), 1, 3))::INT + 1])) / sqrt(greatest(len(g), 1)) + {intercept} AS z
  FROM grams, w)
SELECT page_id, host, path, CASE {name} ELSE NULL END AS rule,
  CASE {kind} ELSE CASE WHEN coalesce(z, {intercept}) > 0 THEN 'block' ELSE 'allow' END END AS verdict
FROM scored"""
