"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from `LABELLED`, a small table of host names by subject, with paths, each with and without common
prefixes and endings. Unwanted subjects are gambling, drug sales, adult content, money schemes, counterfeits, pirated software,
malware, advertising servers and link spam; names that only speak about such a thing (a museum, a study, a clinic) are wanted.
Wanted rows count three times as much, so a host of which the model knows nothing is allowed. Null urls and urls without `://` have empty host and path; no rule fits them and the model allows them (there is nothing to
read). Of rules that fit, the one with the longest text wins, then the first by name. Repeated rows are judged alike; other
columns, also ones named like the results, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .spans import lanes, mix

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

BITS = 15
_GRAMS = (3, 4, 5)

_SUBJECTS = {
    "casino poker slots roulette blackjack jackpot betting sportsbook bingo lottery bets": "online- best- royal- vip- -bonus -club -777 -24 play- lucky- win- -stars",
    "viagra cialis xanax tramadol phentermine pills meds steroids": "cheap- buy- order- discount- -store -online -shop -without-prescription -express",
    "porn xxx sex escort nude webcam milf hookup adult": "free- hot- -tube -videos -cams -chat -girls -live -dating",
    "payday-loans quick-loans forex-signals bitcoin-doubler cash-prizes easy-money get-rich debt-relief miracle-diet": "fast- instant- -now -today -guaranteed -secrets",
    "replica-watches fake-rolex replica-handbags counterfeit-shoes": "luxury- -outlet -sale top-",
    "torrent warez keygen serials crack cracked-apps": "free- -download -full -zone mega- -hub",
    "malware phishing trojan-loader verify-account wallet-login": "secure- -update -alert -support",
    "adserver adtrack ads popunder banner-exchange clicktrack adclick affiliate-offers": "go- -delivery -network -media cdn- -tracker -srv",
    "spam link-exchange link-farm backlinks content-spinner splog doorway-pages": "seo- auto- -directory -network -host -blast",
}
_GOOD = """news weather library museum university college school kindergarten city county village hospital clinic pharmacy dentist parks
transit railway airport history science physics biology chemistry geology astronomy math statistics music orchestra opera theatre
gallery cinema kitchen recipes garden gardening travel maps hiking cycling football tennis hockey chess swimming athletics bakery
coffee tea cheese books bookshop publisher press journal archive docs wiki encyclopedia dictionary software python linux kernel
compiler database networks robotics data research lab institute foundation charity church council parliament court police justice
insurance bank savings accounting taxes energy water forest river mountain ocean island desert farm dairy orchard vineyard
architecture carpentry plumbing electrician furniture textiles ceramics photography painting sculpture poetry novels letters
biography genealogy linguistics translation grammar philosophy psychology sociology economics geography climate ecology wildlife
birds horses dogs cats fishing sailing boats engines bicycles cars trains aviation space satellites telescopes
stadt rathaus bibliothek verein schule zeitung wetter reisen kochen handwerk forschung krankenhaus gemeinde museumsverein
mairie musee ecole journal-local meteo voyages cuisine recherche hopital patrimoine librairie jardin theatre-municipal
ayuntamiento biblioteca escuela noticias tiempo viajes cocina investigacion hospital-general patrimonio libreria jardin-botanico
essex sussex middlesex sextet pillow caterpillar spillway adriatic address adventure advice roads headset shadows
betta alphabet better spruce winery winter window linkedlist blinking cracker-recipes nutcracker hotel photos
casino-history-museum monte-carlo-museum poker-math-lecture lottery-research lottery-fund-charity betting-law-institute spam-filter-research
phishing-awareness malware-research-lab drug-safety-agency pill-identification sex-education adult-education adult-literacy
advertising-history link-theory torrent-river-park crack-climbing debt-counselling loan-library slot-canyon-park jackpot-novel""".split()


def _names() -> tuple[list[str], list[str]]:
    """(unwanted, wanted) names of the subjects, each alone and with its companions."""
    bad = []
    for heads, companions in _SUBJECTS.items():
        for i, h in enumerate(heads.split()):
            own = companions.split()
            bad += [h, *(c + h if c.endswith("-") else h + c for c in (own[i % len(own)], own[(3 * i + 1) % len(own)], own[(5 * i + 2) % len(own)]))]
            bad.append(bad[-1].replace("-", ""))
    good = list(_GOOD)
    places = "city my the open national -online -club -blog -shop -info".split()
    good += [f"{p}-{g}" if not p.startswith("-") else g + p for i, g in enumerate(_GOOD) for p in (places[i % len(places)],)]
    good += [x.replace("-", "") for x in good[len(_GOOD) :: 2]]
    return list(dict.fromkeys(bad)), list(dict.fromkeys(good))


_PATHS = ["", "/", "/about", "/en/12", "/de/40/", "/fr/7.html", "/p/905", "/index.html", "/2024/05/report", "/blog/post-1", "/contact", "/history", "/es/303"]
_GOOD_PATHS = [*_PATHS, "/research/papers", "/events/concert"]
_BAD_PATHS = [*_PATHS, "/casino/bonus", "/download/crack"]
_ENDINGS = ["com", "net", "org", "co.uk", "de", "info", "fr", "io"]
#: (host, path, 1: unwanted)
LABELLED = [(f"{pre}{name}.{_ENDINGS[(k + 3 * j) % 8]}", paths[(k + j * 7) % len(paths)], y) for names, paths, y in zip(_names(), (_BAD_PATHS, _GOOD_PATHS), (1, 0), strict=True) for k, name in enumerate(names) for j, pre in enumerate(("", "www.", "blog.", "m."))]


def host(url: str | Column = "url") -> Column:
    c = F.col(url) if isinstance(url, str) else url
    h = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str | Column = "url") -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host_: Column, path_: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null. Rules are few and constant: they become one expression."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):  # a later `when` wins
        h, _, p = rule.partition("/")
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed n-gram) of every different n-gram of each row's host and path, with marks of their begins and ends."""
    k = len(hosts)
    parts = [b"^" + x.encode("utf-8", "replace") + b"$" for x in (*hosts, *paths)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.fromiter(map(len, parts), np.int64, 2 * k)
    place = np.repeat(np.arange(2 * k), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes from here to the part's end
    eight, out = lanes(data), []
    for n in _GRAMS:
        at = np.flatnonzero(left >= n)
        gram = eight[at] & np.uint64((1 << 8 * n) - 1)
        h = mix((gram << np.uint64(8)) ^ np.where(place[at] < k, n * 2, n * 2 + 1).astype(np.uint64)) >> np.uint64(64 - BITS)
        out.append((place[at] % max(1, k)) << BITS | h.astype(np.int64))
    found = np.unique(np.concatenate(out))
    return found >> BITS, found & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """0 where there is neither host nor path."""
        row, col = features(hosts, paths)
        z = np.bincount(row, self.weights[col], len(hosts)) + self.bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.where([bool(h or p_) for h, p_ in zip(hosts, paths, strict=True)], p, 0.0)


_fitted: list[Model] = []


def fit(labelled: list[tuple[str, str, int]] | None = None, rounds: int = 300, ridge: float = 5e-4, wanted: float = 0.75) -> Model:
    """Full-batch gradient descent with momentum; the table is small and the result the same each time. wanted: the share of the weight that rows of class 0 have. Without a table, LABELLED is used."""
    if labelled is None:
        if not _fitted:
            _fitted.append(fit(LABELLED, rounds, ridge, wanted))
        return _fitted[0]
    y = np.array([t for _, _, t in labelled], float)
    share = np.where(y == 1, (1 - wanted) / max(1, (y == 1).sum()), wanted / max(1, (y == 0).sum()))
    row, col = features([h for h, _, _ in labelled], [p for _, p, _ in labelled])
    w, b = np.zeros(1 << BITS), 0.0
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(rounds):
        z = np.bincount(row, w[col], len(labelled)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        gw = np.bincount(col, g[row], len(w)) + ridge * w
        vw, vb = 0.9 * vw - 1.0 * gw, 0.9 * vb - 0.3 * g.sum()
        w, b = w + vw, b + vb
    return Model(w, b)


def judge(pages: DataFrame, model: Model, rules: dict[str, str] | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row."""
    import pyarrow as pa

    ship(pages.sparkSession)
    weights, bias = model.weights.astype(np.float32), model.bias

    @F.arrow_udf("double")
    def scored(hosts, paths):
        h, p = hosts.to_pylist(), paths.to_pylist()
        out = [Model(weights, bias).scores(h[at : at + 2000], p[at : at + 2000]) for at in range(0, len(h), 2000)]
        return pa.array(np.concatenate([np.zeros(0), *out]), pa.float64())

    parts = pages.select(key, host(url).alias("host"), path(url).alias("path"))
    rules = rules or {}
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", scored("host", "path"))
    verdict = F.lit(None).cast("string")
    for rule, what in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    return ruled.select(key, "host", "path", "rule", F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
