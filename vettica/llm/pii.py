"""Personal data by weak supervision, in DataFrame operations only.

Base spans are the matches of four patterns that pass a check (email; ip: parts up
to 255; card: 16 to 19 digits and Luhn; phone: 8 to 15 digits).  The method adds
spans: looser patterns propose candidates, and labelers vote on every candidate,
base spans included, for (1), against (-1) or not at all (0):

* regular expressions: the strict pattern; a check of digits, ranges or names;
* gazetteers: top-level domains, card issuers, country codes, special networks;
* context: cue words before the span, for and against; letters or digits that touch it.

Spark counts how often each pattern of votes occurs (at most 3^6 votes and four
shapes per kind, however many texts).  Expectation-maximisation on those counts
estimates each labeler's reliability per kind, and a logistic span classifier over
votes and shapes is trained on the posteriors.  It comes back as a sum of literals,
so texts are scored where they are read, without a shuffle.  Candidates that the
classifier accepts and that overlap no base span are added; base spans stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written so that no search starts twice inside one run of
#: characters (\G is the end of the match before) and no loop backtracks.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without these a text has no match.
CLUE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: What the method looks at beside them: spelled-out addresses, groups of eight hex
#: numbers, four groups of four digits inside a longer run, numbers without +.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
LOOSE_CLUE = {"email": r"[\[({]at[\])}]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[\x20-]?[0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}

#: Gazetteers and cue words of the labelers.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|eu|ch|at|us|ca|au|jp|br"
COUNTRIES = "1|33|34|39|31|41|43|44|45|46|47|48|49|61|81|86|91"
CUES = {
    "email": r"mail|contact|write|correo|schreib|courriel|address",
    "ip": r"\bip\b|host|server|address|network|from|login",
    "card": r"card|visa|master|credit|karte|carte|tarjeta|pay",
    "phone": r"tel|phone|call|fax|mobile|ruf|appel|llam|contact",
}
AGAINST = r"version|build|isbn|issn|order|invoice|serial|sha|token|commit|section|chapter|ticket|release"
CONTEXT = 24
LABELERS = ("strict", "check", "gazetteer", "cue", "against", "touched")


# --- spans inside a row ----------------------------------------------------


def _found(frame: DataFrame, name: str, pattern: str, clue: str, text: str = "_text") -> DataFrame:
    """Adds ``name``: array of (start, end, piece) of all matches, in code points.

    Matches and the text between them alternate; starts are sums of the lengths
    before, taken in blocks so that a text with very many matches stays cheap."""
    block = 256
    seen = F.col(text).contains(clue) if clue == "@" else F.col(text).rlike(clue)
    nothing = F.array().cast("array<string>")
    frame = frame.withColumn("_hit", F.when(seen, F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).otherwise(nothing))
    frame = frame.withColumn("_gap", F.when(F.size("_hit") > 0, F.split(F.col(text), pattern, -1)).otherwise(nothing))
    frame = frame.withColumn("_len", F.zip_with(F.slice("_gap", 1, F.size("_hit")), "_hit", lambda g, h: F.length(g) + F.length(h)))
    add: Callable[[Column, Column], Column] = lambda s, x: s + x
    blocks = F.sequence(F.lit(0), F.floor((F.size("_hit") - 1) / block).cast("int"))
    frame = frame.withColumn("_base", F.when(F.size("_hit") > 0, F.transform(blocks, lambda b: F.aggregate(F.slice("_len", F.lit(1), b * block), F.lit(0), add))))

    def span(hit: Column, i: Column) -> Column:
        b = F.floor(i / block).cast("int")
        end = F.get("_base", b) + F.aggregate(F.slice("_len", b * block + 1, i - b * block + 1), F.lit(0), add)
        return F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("piece"))

    return frame.withColumn(name, F.transform("_hit", span)).drop("_hit", "_gap", "_len", "_base")


def _digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return s + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, piece: Column) -> Column:
    """The check of a base match."""
    digits = F.length(_digits(piece))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return piece.rlike(rf"\A{part}\.{part}\.{part}\.{part}\z")
    if kind == "card":
        return F.when(digits.between(16, 19), _luhn(_digits(piece))).otherwise(False)
    return digits.between(8, 15) if kind == "phone" else F.lit(True)


def _check_of(kind: str) -> Callable[[Column], Column]:
    return lambda s: _passes(kind, s["piece"])


def _plausible(kind: str, piece: Column) -> Column:
    """The check labeler's vote on any candidate."""
    digits = F.length(_digits(piece))
    if kind == "email":
        good, bad = piece.rlike(r"(?:\.|dot[\])}])\x20?[A-Za-z]{2,6}\z"), piece.rlike(r"[0-9-]\z")
    elif kind == "ip":
        good, bad = piece.contains(".") & _passes(kind, piece), F.lit(False)
    elif kind == "card":
        good = F.when(digits.between(13, 19), _luhn(_digits(piece))).otherwise(False)
        bad = ~good
    else:
        good, bad = digits.between(10, 13), digits < 9
    return F.when(good, 1).when(bad, -1).otherwise(0)


def _listed(kind: str, piece: Column) -> Column:
    """The gazetteer labeler's vote."""
    if kind == "email":
        return F.when(F.lower(piece).rlike(rf"(?:\.|[\])}}])\x20?(?:{DOMAINS})\z"), 1).otherwise(0)
    if kind == "ip":
        return F.when(piece.rlike(r"\A0*(?:0|127|22[4-9]|2[3-5][0-9])\."), -1).when(piece.rlike(r"\A(?:0{1,4}:)+"), -1).otherwise(0)
    if kind == "card":
        return F.when(piece.rlike(r"\A[3-6]"), 1).otherwise(-1)
    return F.when(piece.rlike(rf"\A(?:\+|00)(?:{COUNTRIES})[^0-9]"), 1).when(piece.rlike(r"\A\(?[01]"), -1).otherwise(0)


def _voted(kind: str, spans: str, strict: bool, text: str = "_text") -> Column:
    """Spans of a kind with the votes and shapes on each."""

    def one(s: Column) -> Column:
        start, piece = s["start"], s["piece"]
        before = F.lower(F.substring(F.col(text), F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))
        after = F.substring(F.col(text), s["end"] + 1, F.lit(1))
        touched = after.rlike("[A-Za-z0-9]") | before.rlike("[a-z0-9]\\z" if kind != "email" else "[/=]\\z")
        votes = {
            "strict": F.lit(1 if strict else 0),
            "check": _plausible(kind, piece),
            "gazetteer": _listed(kind, piece),
            "cue": F.when(before.rlike(CUES[kind]), 1).otherwise(0),
            "against": F.when(before.rlike(AGAINST), -1).otherwise(0),
            "touched": F.when(touched, -1).otherwise(0),
        }
        shape = F.when(F.length(piece) >= 16, 1).otherwise(0) + F.when(piece.rlike(r"[\x20()-]"), 2).otherwise(0)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), s["end"].alias("end"), *(votes[v].alias(v) for v in LABELERS), shape.alias("shape"))

    return F.transform(F.col(spans), one)


def candidates(documents: DataFrame) -> DataFrame:
    """``documents`` with ``_base`` (spans that stay) and ``_more`` (candidates that
    overlap none of them), arrays of (kind, start, end, votes, shape)."""
    frame = documents.withColumn("_text", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        frame = _found(frame, f"_raw_{kind}", STRICT[kind], CLUE[kind])
        frame = frame.withColumn(f"_raw_{kind}", F.filter(f"_raw_{kind}", _check_of(kind)))
        frame = _found(frame, f"_loose_{kind}", LOOSE[kind], LOOSE_CLUE[kind])
    frame = frame.withColumn("_base", F.concat(*(_voted(k, f"_raw_{k}", True) for k in KINDS)))
    frame = frame.withColumn("_more", F.concat(*(_voted(k, f"_loose_{k}", False) for k in KINDS)))
    apart = F.filter("_more", lambda m: ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return frame.withColumn("_more", apart).drop(*(f"_{w}_{k}" for w in ("raw", "loose") for k in KINDS))


# --- reliabilities and classifier ------------------------------------------


Pattern = tuple[str, tuple[int, ...], int, int]  # kind, votes, shape, count


def reliabilities(patterns: list[Pattern], rounds: int = 60) -> list[float]:
    """The posterior of each pattern, by expectation-maximisation per kind.

    Labelers are independent given the truth; each has a table of its three votes
    under either truth, smoothed, starting from the sum of votes."""
    post = [1 / (1 + math.exp(-1.5 * sum(p[1]))) for p in patterns]
    for kind in KINDS:
        mine = [i for i, p in enumerate(patterns) if p[0] == kind]
        for _ in range(rounds if mine else 0):
            total = [sum((post[i] if y else 1 - post[i]) * patterns[i][3] for i in mine) + 1 for y in (0, 1)]
            table = [
                [
                    {v: (sum((post[i] if y else 1 - post[i]) * patterns[i][3] for i in mine if patterns[i][1][k] == v) + (2 if v == (1 if y else -1) else 1)) / (total[y] + 3) for v in (-1, 0, 1)}
                    for k in range(len(LABELERS))
                ]
                for y in (0, 1)
            ]
            for i in mine:
                logs = [math.log(total[y]) + sum(math.log(table[y][k][v]) for k, v in enumerate(patterns[i][1])) for y in (0, 1)]
                post[i] = 1 / (1 + math.exp(max(-500.0, min(500.0, logs[0] - logs[1]))))
    return post


def _features(kind: str, votes: tuple[int, ...], shape: int) -> list[int]:
    """Which of the classifier's weights apply: offset, kind, votes, shapes."""
    base = 1 + len(KINDS)
    at = [0, 1 + KINDS.index(kind)]
    at += [base + 2 * k + (v > 0) for k, v in enumerate(votes) if v]
    return at + [base + 2 * len(votes) + bit for bit in (0, 1) if shape >> bit & 1]


def train(patterns: list[Pattern], post: list[float], rounds: int = 500, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of the span classifier, fitted to the posteriors by gradient steps;
    a pattern weighs the logarithm of its count, so that a frequent one does not
    drown the others."""
    size = 1 + len(KINDS) + 2 * len(LABELERS) + 2
    weights = [0.0] * size
    rows = [(_features(*p[:3]), q, 1 + math.log(p[3])) for p, q in zip(patterns, post, strict=True)]
    mass = sum(r[2] for r in rows) or 1.0
    for _ in range(rounds):
        step = [-decay * w for w in weights]
        for at, wanted, times in rows:
            miss = wanted - 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(weights[a] for a in at)))))
            for a in at:
                step[a] += miss * times / mass
        weights = [w + rate * s for w, s in zip(weights, step, strict=True)]
    return weights


def fit(found: DataFrame) -> list[float]:
    """The classifier's weights from all candidates of ``candidates``."""
    each = found.select(F.explode(F.concat("_base", "_more")).alias("c")).select("c.kind", *(f"c.{v}" for v in LABELERS), "c.shape")
    rows = each.groupBy("kind", *LABELERS, "shape").agg(F.count("*").alias("n")).collect()
    patterns = sorted((r.kind, tuple(r[v] for v in LABELERS), r["shape"], r.n) for r in rows)
    return train(patterns, reliabilities(patterns))


def _score(weights: list[float]) -> Callable[[Column], Column]:
    """The classifier's value of a candidate as a sum of literals."""

    def of(c: Column) -> Column:
        value = F.lit(weights[0])
        for k, kind in enumerate(KINDS):
            value += F.when(c["kind"] == kind, weights[1 + k]).otherwise(0.0)
        for k, name in enumerate(LABELERS):
            at = 1 + len(KINDS) + 2 * k
            value += F.when(c[name] == 1, weights[at + 1]).when(c[name] == -1, weights[at]).otherwise(0.0)
        at = 1 + len(KINDS) + 2 * len(LABELERS)
        for bit in (0, 1):
            value += F.when(c["shape"].bitwiseAND(1 << bit) != 0, weights[at + bit]).otherwise(0.0)
        return value

    return of


def with_spans(documents: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """``documents`` with ``_text``, ``_base`` and ``_spans``: all spans by kind and
    start.  Without weights the classifier is trained on these documents first."""
    found = candidates(documents)
    if weights is None:
        weights = fit(candidates(documents.select("text")))
    value = _score(weights)
    plain: Callable[[Column], Column] = lambda s: F.struct(s["kind"], s["start"], s["end"])
    more = F.filter("_more", lambda c: value(c) > 0)
    order = {k: i for i, k in enumerate(KINDS)}

    def rank(s: Column) -> Column:
        place = F.lit(len(KINDS))
        for k, i in order.items():
            place = F.when(s["kind"] == k, i).otherwise(place)
        return F.struct(place.alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))

    sorted_spans: Callable[[Column], Column] = lambda spans: F.transform(F.array_sort(F.transform(spans, rank)), plain)
    return found.withColumn("_spans", sorted_spans(F.concat(F.col("_base"), more))).withColumn("_base", sorted_spans(F.col("_base"))).drop("_more")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(documents: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found).

    Counts and digest are of the base spans; ``spans`` and the array ``found`` have
    all.  Null texts count as empty and have none.  Repeated rows and rows without
    doc_id are rows like others.  Other columns are not read."""
    frame = with_spans(documents.select("doc_id", "text"), weights)

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return frame.select("doc_id", *map(count, KINDS), F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_spans").alias("spans"), F.col("_spans").alias("found"))


def mask_personal_data(documents: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """``documents`` with every span replaced by its kind in brackets; of overlapping
    spans the first names the whole stretch.  Null texts stay null, ``n_chars``, if
    there, follows the new text."""
    # the row travels as one column, so that no name of its own is in the way
    frame = with_spans(documents.select(F.struct("*").alias("_row"), "text"), weights)
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("_text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        tag = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], gap, tag)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    rest: Callable[[Column], Column] = lambda state: F.concat(state["out"], F.substring(F.col("_text"), state["at"] + 1, F.length("_text")))
    masked = F.when(F.size("_spans") > 0, F.aggregate(ordered, start, cut, rest)).otherwise(F.col("text"))
    frame = frame.withColumn("_masked", masked)
    new = {"text": F.col("_masked")}
    if "n_chars" in documents.columns:
        length = F.length("_masked").cast(documents.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.size("_spans") > 0, length).otherwise(F.col("_row.n_chars"))
    return frame.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in documents.columns))
