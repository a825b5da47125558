"""Personal data by candidate gradient boosting; DataFrame operations only.

The base patterns (email, ip, card, phone) are always reported. Beside them, high-recall generators propose spans that may
overlap; boosted trees score each candidate by format and context, and a threshold of its kind, calibrated for precision on
examples that weren't fitted, selects it. A candidate that overlaps a base span is left out, as the base span covers the place.
Selected spans are gone through from left to right: of two that overlap, the longer stays, then the likelier, then the one of the
first kind. The model is fitted once from texts that this module makes. The work on a text follows its length.

Positions count code points, ends are exclusive. Null and empty texts have no spans; texts of any length are read whole.
Repeated rows are judged each on its own. Result columns replace columns of their names; other ones may be kept by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]

_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# A start within a run of its own first class can match only where the last match ended: this keeps long runs linear.
_PATTERN = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORTH = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}

_PROPOSALS = {
    "email": (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]{2,24}){1,4}", r"(?i)@|[\[({]at[\])}]"),
    "phone": (r"(?<![0-9A-Za-z.])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])", r"[0-9][)\x20./-]{1,3}[0-9]"),
    "card": (r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20. -][0-9]{2,6}){2,4}(?![0-9A-Za-z])", r"[0-9]{4}[\x20. -][0-9]{2}"),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "secret": (r"(?<![A-Za-z0-9/+_=-])[A-Za-z0-9/+_=-]{16,}+(?![A-Za-z0-9/+_=-])|(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\x20?[:=]\x20?[\"']?[^\s\"']{6,}+", r"(?i)password|passwd|pwd|token|secret|api[_-]?key|[A-Za-z0-9/+_=-]{16}"),
}
_CUES = {"email": r"(?i)mail|contact|write|kontakt|correo|courriel", "phone": r"(?i)tel|phone|call|mobile|fax|cell|ruf|llam|appel", "card": r"(?i)card|visa|master|amex|karte|tarjeta|carte", "iban": r"(?i)iban|account|bank|konto|cuenta|compte", "secret": r"(?i)password|passwd|pwd|token|secret|key|login|credential"}
_AGAINST = r"(?i)isbn|version|\bv[0-9]|figure|page|order|room|score|section|year|from [0-9]|\$|€|%"
_CONTEXT = 28


#: Elements that _scan() goes through between two copies of what it has.
_BLOCK = 256


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body asks for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, state: Column, none: Column, step) -> Column:
    """What step(state, item) gives, item after item: a struct of the next state and `emit`, an array of what comes out (of the type of none).

    The result grows by a block at a time, so the work is linear in the items up to some ten thousands and nearly so beyond.
    """

    def inner(acc: Column, x: Column) -> Column:
        return _let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["emit"]).alias("out")))

    def outer(acc: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

    def blocks(own: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / _BLOCK).cast("int")), lambda i: F.slice(own, i * _BLOCK + 1, F.lit(_BLOCK)))
        return F.aggregate(cut, F.struct(state.alias("state"), none.alias("out")), outer, lambda acc: acc["out"])

    return _let(items, lambda own: F.when(F.size(own) > 0, blocks(own)).otherwise(none))


def _none(fields: str) -> Column:
    return F.expr(f"CAST(array() AS array<struct<{fields}>>)")


def _spans(text: Column, pattern: str, worth: str) -> Column:
    """array<struct<start,end,hit,before,after>> of a pattern's matches, from left to right without overlaps. Places come from the lengths of the matches and of the pieces between them."""
    none = _none("start:int,end:int,hit:string,before:string,after:string")
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def step(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        own = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), F.substring(x["gap"], -_CONTEXT, _CONTEXT).alias("before"), F.substring(x["next"], 1, 8).alias("after"))
        return F.struct(end.alias("state"), F.array(own).alias("emit"))

    pieces = _let(both, lambda b: F.transform(b["hits"], lambda m, i: F.struct(F.get(b["gaps"], i).alias("gap"), m.alias("hit"), F.get(b["gaps"], i + 1).alias("next"))))
    return F.when(text.rlike(worth), _scan(pieces, F.lit(0), none, step)).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of 12 to 19 digits passes the Luhn check; false for other lengths."""

    def total(d: Column) -> Column:
        places = F.transform(d, lambda x, i: F.when((F.size(d) - i) % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
        return F.aggregate(places, F.lit(0), lambda acc, x: acc + x)

    return F.when(F.length(digits).between(12, 19), _let(F.split(digits, "").cast("array<int>"), total) % 10 == 0).otherwise(False)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


_VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x["hit"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda x: _let(_digits(x["hit"]), luhn),
    "phone": lambda x: F.length(_digits(x["hit"])).between(9, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    """Spans of a base kind, each match that fails its check dropped."""
    return F.filter(_spans(text, _PATTERN[kind], _WORTH[kind]), _VALID[kind])


_CANDIDATE = "start:int,kind:int,end:int,hit:string,before:string,after:string,digits:string"


def candidates(text: Column) -> Column:
    """array<struct<start,kind int,end,hit,before,after,digits>> of all proposals; they may overlap."""
    empty = _none(_CANDIDATE)

    def named(kind: str):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"), _digits(x["hit"]).alias("digits"))

    each = [F.transform(_spans(text, p, w), named(kind)) for kind, (p, w) in _PROPOSALS.items()]
    return F.concat(empty, *each)


def features(x: Column) -> list[Column]:
    """Numbers of a candidate's format and context; of a candidate with its digits."""
    hit, before = x["hit"], x["before"]
    d = x["digits"]
    n = F.length(hit)
    count = lambda pattern: (n - F.length(F.regexp_replace(hit, pattern, ""))).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    cue = reduce(lambda a, b: a | b, [(x["kind"] == KINDS.index(k)) & before.rlike(p) for k, p in _CUES.items()])
    inner = reduce(lambda a, b: a | b, [(x["kind"] == KINDS.index(k)) & hit.rlike(p) for k, p in _CUES.items()])
    return [
        x["kind"].cast("double"),
        n.cast("double"),
        F.length(d).cast("double"),
        F.length(d) / n,
        count(r"[A-Z]"),
        count(r"[a-z]"),
        count(r"[\x20./()-]"),
        flag(luhn(d)),
        flag(hit.startswith("(")),
        flag(cue),
        flag(inner),
        flag(before.rlike(_AGAINST)),
        flag(x["after"].rlike(r"^[\x20]?(?:%|€|EUR|USD|kg|km|cm|mm)")),
        flag(hit.rlike(r"(?i)[\[({]at[\])}]|@")),
        flag(hit.rlike(r"(?i)[\[({]dot[\])}]|\.[A-Za-z]{2,}")),
        flag(hit.rlike(r"^(?:AKIA|ASIA|ghp_|sk-|xox)")),
        flag(hit.rlike(r"[:=]")),
        F.size(F.array_distinct(F.split(hit, ""))) / n,
        flag(hit.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)")),
    ]


def examples(n: int = 2400, seed: int = 11) -> list[tuple[str, int]]:
    """(text, 1 if the marked span is personal) of texts made from a fixed seed; a text has one thing to be found, between two marks."""
    r = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *xs: xs[int(r.integers(len(xs)))]
    syllables = "an ber con der el fi gu hin ist jor ka lem mo nu or pel qua ris sol ter un ver wil zen th on ed".split()
    word = lambda: "".join(pick(*syllables) for _ in range(int(r.integers(1, 4))))
    some = lambda k: " ".join(word() for _ in range(k))
    code = lambda k, a="abcdef0123456789": "".join(a[i] for i in r.integers(0, len(a), k))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def card() -> str:
        d = pick("4", "5", "37") + digits(13)
        s = sum((v * 2 - 9 if v > 4 else v * 2) if i % 2 == 0 else v for i, v in enumerate(int(c) for c in reversed(d)))
        return d + str(-s % 10)

    good = [
        lambda: f"{word()}.{word()} {pick('[at]', '(at)', '{at}')} {word()} {pick('[dot]', '(dot)')} {pick('com', 'org', 'de')}",
        lambda: f"{word()}{digits(2)}{pick('[at]', '(at)')}{word()}.{pick('com', 'net', 'fr')}",
        lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{pick('tel ', 'call me at ', 'Telefon ', 'phone: ', 'mobile ')}|{digits(3)}{pick('-', '.', ' ')}{digits(3)}{pick('-', '.', ' ')}{digits(4)}",
        lambda: f"{pick('Tel. ', 'fax ', 'tél ')}|0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
        lambda: ".".join([(c := card())[:4], c[4:8], c[8:12], c[12:]]),
        lambda: f"{pick('card ', 'visa ', 'Karte ')}|{digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}",
        lambda: f"{pick('DE', 'FR', 'ES', 'GB')}{digits(2)}{pick('', ' ')}{digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}",
        lambda: f"{pick('IBAN ', 'account ')}|{pick('DE', 'AT', 'NL')}{digits(18 + int(r.integers(3)) * 0)}",
        lambda: f"password={code(18)}",
        lambda: f"{pick('api_key', 'token', 'secret')} = \"{code(pick(32, 40))}",
        lambda: f"AKIA{code(16, upper)}",
        lambda: f"{pick('', 'password=', 'token = ')}{code(int(r.integers(129, 400)), upper + upper.lower())}",
        lambda: f"{pick('pwd', 'passwd')}: {word()}{digits(4)}!{code(3, upper)}",
    ]
    bad = [
        lambda: f"{pick('version ', 'v')}|{digits(2)}.{digits(2)}.{digits(2)}",
        lambda: f"{pick('from ', 'in ', 'between ')}|19{digits(2)}-20{digits(2)}",
        lambda: f"{pick('ISBN ', 'order ', 'page ', 'section ')}|{digits(3)}-{digits(2)}-{digits(5)}",
        lambda: f"20{digits(2)}-0{int(r.integers(1, 9))}-1{int(r.integers(0, 9))}",
        lambda: f"{pick('score ', 'odds ', 'room ')}|{digits(2)}-{digits(2)}",
        lambda: f"{digits(2)}.{digits(3)} {digits(3)}",
        lambda: f"{digits(4)} {digits(2)} {digits(3)}",
        lambda: f"{'-'.join(word() for _ in range(5))}",
        lambda: f"{'=' * int(r.integers(16, 60))}",
        lambda: f"{'-_' * int(r.integers(9, 30))}",
        lambda: "".join(word() for _ in range(8)),
        lambda: pick("=", "-_", "abc/", word()) * int(r.integers(130, 300)),
        lambda: f"/{word()}/{word()}/{word()}/{word()}/{word()}",
        lambda: f"AB{digits(2)} {code(4, upper)} {code(4, upper)}",
        lambda: f"{pick('secret: ', 'token: ', 'the key = ')}{word()}{word()}",
        lambda: f"{word()} (at) {word()}. {word()}",
        lambda: f"{digits(2)}/{digits(2)}/20{digits(2)}",
    ]
    out = []
    for i in range(n):
        y = i % 2
        shape = pick(*(good if y else bad))()
        lead, _, core = shape.rpartition("|")
        out.append((f"{some(int(r.integers(1, 6)))} {lead}{core} {some(int(r.integers(1, 6)))}", y))
    return out


@dataclass
class Model:
    trees: boosting.Boosted
    n_features: int
    #: Least log-odds by kind.
    least: dict[str, float]


_fitted: dict[str, Model] = {}


def fit(spark: SparkSession, n: int = 2400, precision: float = 0.97) -> Model:
    """Fit on two thirds of the made texts, calibrate the kinds' thresholds on the rest. n bounds what the driver reads."""
    key = f"{spark.sparkContext.applicationId}-{n}-{precision}"
    if key not in _fitted:
        made = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(examples(n))], "i int, text string, y int").coalesce(2)
        found = made.select("i", "y", F.explode(candidates(F.col("text"))).alias("c"))
        rows = found.select("i", "y", F.array(*features(F.col("c"))).alias("f")).collect()  # bounded by n
        x, y, i = np.array([r.f for r in rows]), np.array([r.y for r in rows]), np.array([r.i for r in rows])
        held = i % 3 == 0
        trees = boosting.fit(x[~held], y[~held], trees=24, depth=3)
        raw = trees.raw(x)
        least = {k: max(0.0, boosting.threshold_for(raw[held & (x[:, 0] == j)], y[held & (x[:, 0] == j)], precision)) for j, k in enumerate(KINDS) if (held & (x[:, 0] == j)).any()}
        _fitted[key] = Model(trees, x.shape[1], least)
    return _fitted[key]


def _free(base: Column, proposed: Column) -> Column:
    """The proposals that overlap no base span, by start. Base spans that begin no later reach to some place at most, one that begins later begins at some place at least."""
    none = _none(_CANDIDATE)
    blank = [F.lit("").alias(k) for k in ("hit", "before", "after", "digits")]
    marks = F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.lit(-1).alias("kind"), x["end"].alias("end"), *blank))

    def forward(reach: Column, x: Column) -> Column:
        mark = x["kind"] < 0
        return F.struct(F.when(mark, F.greatest(reach, x["end"])).otherwise(reach).alias("state"), F.when(mark | (x["start"] >= reach), F.array(x)).otherwise(none).alias("emit"))

    def backward(ahead: Column, x: Column) -> Column:
        mark = x["kind"] < 0
        return F.struct(F.when(mark, x["start"]).otherwise(ahead).alias("state"), F.when(~mark & (x["end"] <= ahead), F.array(x)).otherwise(none).alias("emit"))

    once = _scan(F.array_sort(F.concat(proposed, marks)), F.lit(0), none, forward)
    return F.when((F.size(base) > 0) & (F.size(proposed) > 0), F.reverse(_scan(F.reverse(once), F.lit(2**31 - 1), none, backward))).otherwise(F.array_sort(proposed))


_CHOSEN = "s:struct<start:int,kind:int,end:int>,z:double"


def _best(chosen: Column) -> Column:
    """The selected spans without overlaps, from left to right. chosen: array<struct<s,z>> by start."""
    none, nothing = _none(_CHOSEN), F.expr(f"CAST(NULL AS struct<{_CHOSEN}>)")

    def step(last: Column, x: Column) -> Column:
        rank = lambda v: F.struct((v["s"]["end"] - v["s"]["start"]).alias("n"), v["z"].alias("z"), (-v["s"]["kind"]).alias("k"))
        apart = x["s"]["start"] >= last["s"]["end"]
        better = F.when(apart | last.isNull() | (rank(x) > rank(last)), x).otherwise(last)
        return F.struct(better.alias("state"), F.when(apart, F.array(last)).otherwise(none).alias("emit"))

    # The last span comes out where a span behind all others follows.
    end = F.array(F.struct(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(0).alias("kind"), F.lit(2**31 - 1).alias("end")).alias("s"), F.lit(0.0).alias("z")))
    return F.when(F.size(chosen) > 1, _scan(F.concat(chosen, end), nothing, none, step)).otherwise(chosen)


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, base: spans of the base patterns, spans: all). A span is struct<start,kind index,end>, in that order. No shuffle: every row is judged in place."""
    c = F.coalesce(F.col(text).cast("string"), F.lit(""))
    span = lambda x, k: F.struct(x["start"].alias("start"), (k if isinstance(k, Column) else F.lit(k)).alias("kind"), x["end"].alias("end"))
    none = _none("start:int,kind:int,end:int")
    of_kind = lambda j: lambda x: span(x, j)  # noqa: E731  # a default argument would become the position
    base = F.concat(none, *[F.transform(base_spans(c, kind), of_kind(j)) for j, kind in enumerate(BASE)])
    one = docs.select(key, *keep, F.array_sort(base).alias("base"), candidates(c).alias("proposed"))
    two = one.select(key, *keep, "base", F.transform(_free(F.col("base"), F.col("proposed")), lambda x: F.struct(span(x, x["kind"]).alias("s"), F.array(*features(x)).alias("f"))).alias("proposed"))
    scored = F.transform("proposed", lambda x: F.struct(x["s"].alias("s"), model.trees.column([F.get(x["f"], j) for j in range(model.n_features)]).alias("z")))
    three = two.select(key, *keep, "base", scored.alias("proposed"))

    def passes(x: Column) -> Column:
        out = F.lit(False)
        for kind, z in model.least.items():
            out = F.when(x["s"]["kind"] == KINDS.index(kind), x["z"] >= z).otherwise(out)
        return out

    four = three.select(key, *keep, "base", F.filter("proposed", passes).alias("chosen"))
    return four.select(key, *keep, "base", F.array_sort(F.concat("base", F.transform(_best(F.col("chosen")), lambda x: x["s"]))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone: base spans, base_sha256, spans)."""
    found = scan(docs, model, key, text)
    is_kind = lambda j: lambda x: x["kind"] == j
    counts = [F.size(F.filter("base", is_kind(j))).cast("bigint").alias(f"n_{kind}") for j, kind in enumerate(BASE)]
    return found.select(key, *counts, F.sha2(F.encode(written(F.col("base")), "UTF-8"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text with each span, or group of overlapping spans, replaced by `[kind]`)."""
    names = F.array(*map(F.lit, KINDS))
    found = scan(docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")), model, key, "_text", ("_text",))
    none = F.expr("CAST(array() AS array<string>)")
    # Code points of the text as an array: a piece is cut out without counting from the text's beginning.
    letters = F.split("_text", "")

    def pieces(own: Column) -> Column:
        between = lambda a, n: F.array_join(F.slice(own, a + 1, n), "")

        def step(at: Column, x: Column) -> Column:
            fresh = x["start"] >= at
            piece = F.array(F.concat(between(at, F.greatest(x["start"] - at, F.lit(0))), F.lit("["), F.get(names, x["kind"]), F.lit("]")))
            return F.struct(F.greatest(at, x["end"]).alias("state"), F.when(fresh, piece).otherwise(none).alias("emit"))

        reach = F.array_max(F.transform("spans", lambda x: x["end"]))
        return F.concat(F.array_join(_scan(F.col("spans"), F.lit(0), none, step), ""), between(reach, F.size(own)))

    return found.select(key, F.when(F.size("spans") > 0, _let(letters, pieces)).otherwise(F.col("_text")).alias(text))
