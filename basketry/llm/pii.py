"""Personal data by weak supervision, in DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.store import staged

#: The base kinds in order. They match what the plain forms
#:   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
#: match, in time linear in the text: runs are possessive, and a run is entered at its start or where a match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms of the same kinds that only the classifier can admit.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to be tried.
HINT = {"email": "[@\\]\\)]", "ip": "[0-9A-Fa-f][.:]", "card": "[0-9]", "phone": "[0-9]"}
#: Gazetteers: top-level domains, first digits of card issuers, calling codes.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu", "example")
ISSUERS = "^(?:3[47]|4|5[1-5]|6011|65|2[2-7])"
CALLING = "^(?:\\+?1|\\+?3[0-9]|\\+?4[0-9]|\\+?[5-9][0-9])"
#: Words before or after a span that speak for its kind, or against any.
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel|address",
    "ip": "\\bip\\b|host|server|addr|login|network|client",
    "card": "card|visa|master|amex|credit|debit|konto|tarjeta|carte|pay",
    "phone": "phone|tel|call|mobile|cell|fax|dial|llam|appel|anruf",
}
AGAINST = "version|token|sha|md5|isbn|doi|serial|order|invoice|http"
VOTERS = ("regex", "gazetteer", "context", "shape", "edge")

SPAN = "array<struct<s:int,e:int,m:string>>"


def spans_of(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches: array of (s, e, m), code points, end exclusive.

    The pieces between the matches and the matches themselves give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(found, F.split(text, pattern, -1), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("out")))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, 1).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":

        def small(part: Column) -> Column:
            short = F.regexp_replace(part, "^0+", "")
            return F.when(F.length(short) > 3, False).otherwise(F.coalesce(F.try_to_number(short, F.lit("999")), F.lit(0)) <= 255)

        return F.forall(F.split(m, "\\."), small)
    if kind == "card":
        digits = _digits(m)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(_digits(m)).between(9, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def candidates(text: Column, kind: str, base: bool) -> Column:
    """Spans of a kind with base (they count as they stand), one vote (1, 0, -1) of each labeler, and size, a bucket of their length."""

    def judged(x: Column) -> Column:
        m, digits = x["m"], _digits(x["m"])
        before = F.lower(F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24))))
        after = F.lower(F.substring(text, x["e"] + 1, 16))
        around = F.concat(before, F.lit(" "), after)
        good = valid(kind, m) if base else F.lit(False)
        last = F.lower(F.regexp_extract(F.substring(m, -32, 32), "([A-Za-z0-9-]+)$", 1))
        known = {
            "email": _vote(last.isin(*DOMAINS), F.length(last) > 12),
            "ip": _vote(m.rlike("^(?:10|127|172|192)\\.|:"), m.rlike("^0")),
            "card": _vote(digits.rlike(ISSUERS), digits.rlike("^[01]")),
            "phone": _vote(m.rlike(CALLING), F.lit(False)),
        }[kind]
        shape = {
            "email": _vote(F.length(m) < 64, F.length(m) > 128),
            "ip": _vote(F.length(m) >= 7, F.length(m) > 39),
            "card": _vote(m.rlike("^[0-9]{4}([ -]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}$"), ~F.length(digits).between(13, 19)),
            "phone": _vote(m.rlike("[ ().-]"), ~F.length(digits).between(9, 15)),
        }[kind]
        edge_before, edge_after = F.substring(before, -1, 1), F.substring(after, 1, 1)
        joined = edge_before.rlike("[0-9A-Za-z_=\"/]") | edge_after.rlike("[0-9A-Za-z_=/]")
        votes = {
            "regex": _vote(good, ~good) if base else F.lit(0),
            "gazetteer": known,
            "context": _vote(around.rlike(CUES[kind]), around.rlike(AGAINST)),
            "shape": shape,
            "edge": _vote(~joined, joined),
        }
        size = F.least(F.floor(F.length(m) / 4), F.lit(9)).cast("int")
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), good.alias("base"), size.alias("size"), *[votes[v].alias(v) for v in VOTERS])

    found = F.when(text.rlike(HINT[kind]), F.transform(spans_of(text, (BASE if base else LOOSE)[kind]), judged))
    return F.coalesce(found, F.array())


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """The probability of a true span for each (kind, votes), by expectation-maximisation over counts of patterns.

    Each labeler has, for each kind and truth, a share of yes, no and abstain; a kind has a share of true spans. The
    start is the majority vote; shares are smoothed by one count each.
    """
    belief = {(k, v): 0.9 if sum(v) > 0 else 0.1 for k, v, _ in patterns}
    for _ in range(rounds):
        tables: dict = {}
        prior: dict = {}
        for k, v, n in patterns:
            p = belief[k, v]
            one, zero = prior.get(k, (1.0, 1.0))
            prior[k] = (one + n * p, zero + n * (1 - p))
            for i, x in enumerate(v):
                for truth, weight in ((1, n * p), (0, n * (1 - p))):
                    t = tables.setdefault((k, i, truth), {-1: 1.0, 0: 1.0, 1: 1.0})
                    t[x] += weight
        for k, v, _ in patterns:
            odds = math.log(prior[k][0] / prior[k][1])
            for i, x in enumerate(v):
                yes, no = tables[k, i, 1], tables[k, i, 0]
                odds += math.log(yes[x] / sum(yes.values())) - math.log(no[x] / sum(no.values()))
            belief[k, v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return belief


def span_classifier(counts: list[dict], belief: dict) -> dict[tuple, float]:
    """Log odds of a naive-Bayes classifier of spans, trained on the beliefs as soft labels.

    Features are the kind, the size bucket and each vote; the weight of a value is the log ratio of its smoothed
    shares among true and false spans of the kind.
    """
    mass: dict = {}
    for r in counts:
        p = belief[r["kind"], tuple(r[v] for v in VOTERS)]
        for f in ("", "size", *VOTERS):
            key = (r["kind"], f, r[f] if f else 0)
            one, zero = mass.get(key, (0.5, 0.5))
            mass[key] = (one + r["n"] * p, zero + r["n"] * (1 - p))
    out = {}
    for (kind, f, value), (one, zero) in mass.items():
        all_one, all_zero = mass[kind, "", 0]
        out[kind, f, value] = math.log(one / zero) if not f else math.log(one / all_one) - math.log(zero / all_zero)
    return out


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.95, rounds: int = 50) -> DataFrame:
    """Personal data spans in every text: those of the base patterns, and looser ones that a classifier admits.

    Labelers (the base pattern with its check, gazetteers of domains, issuers and calling codes, words around, shape,
    edges) vote on every candidate. The counts of vote patterns, of which there are a few thousand at most whatever
    the input, go to the driver; expectation-maximisation over them estimates how reliable each labeler is, and its
    beliefs train the span classifier, whose weights are applied as column expressions. Base spans always stay; other
    candidates that overlap none of them are added from `threshold` on.

    Returns one row per row of docs: id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of
    kind:start:end by kind, then start, comma-joined), spans (all spans, joined likewise); code points, end exclusive.
    Null counts as empty; texts without spans have the hash of the empty string; equal rows have equal results; an
    empty table gives no row; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    all_ = F.concat(*[candidates(F.col("text"), k, True) for k in BASE], *[candidates(F.col("text"), k, False) for k in LOOSE])
    found = staged(source.select("id", all_.alias("c")), "candidates")
    counts = found.select(F.explode("c").alias("c")).select("c.*").groupBy("kind", "size", *VOTERS).agg(F.count("*").alias("n"))
    counts = [r.asDict() for r in counts.collect()]
    patterns: dict = {}
    for r in counts:
        key = (r["kind"], tuple(r[v] for v in VOTERS))
        patterns[key] = patterns.get(key, 0) + r["n"]
    weights = span_classifier(counts, estimate([(k, v, n) for (k, v), n in sorted(patterns.items())], rounds))
    table = F.create_map(*[F.lit(x) for (k, f, v), w in sorted(weights.items()) for x in (f"{k} {f} {v}", w)]) if weights else F.create_map().cast("map<string,double>")

    def odds(x: Column) -> Column:
        total = F.coalesce(table[F.concat(x["kind"], F.lit("  0"))], F.lit(0.0))
        for f in ("size", *VOTERS):
            total = total + F.coalesce(table[F.concat(x["kind"], F.lit(f" {f} "), x[f].cast("string"))], F.lit(0.0))
        return total

    base = F.filter("c", lambda x: x["base"])
    found = found.select("id", "c", base.alias("base"))
    more = F.filter("c", lambda x: ~x["base"] & ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])) & (odds(x) >= math.log(threshold / (1 - threshold))))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(BASE) for x in (k, i)])

    def joined(spans: Column) -> Column:
        keyed = F.array_sort(F.transform(spans, lambda x: F.struct(order[x["kind"]].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
        return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias(id_col),
        *[number(k) for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat(F.col("base"), more)).alias("spans"),
    )
