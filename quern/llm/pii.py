"""PII: labelers vote on spans, expectation-maximisation weighs them, and a span classifier decides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, let

KEYS = "AKIA|ASIA|AROA|AIza|ghp_|gho_|ghs_|glpat-|sk-|sk_live_|pk_live_|rk_live_|xox[abprs]-|SG\\."
#: What may hold a span at all; cheap, and with the keys' prefixes true of every text in which SPAN finds something.
HINT = "[0-9@=:]"


def hinted(text: Column) -> Column:
    """Plain searches for the keys' prefixes, as alternatives in one expression are tried at every letter."""
    out = text.rlike(HINT)
    for prefix in KEYS.replace("[abprs]-", "").replace("\\", "").split("|"):
        out = out | text.contains(prefix)
    return out


#: Candidate spans. Wide on purpose: labelers and classifier tell which are private. Repeated groups are possessive or
#: bounded, as others cost the matcher a stack frame a turn; what may be long begins only where a run of its letters
#: does, so that no run is looked through again from each of its places.
SPAN = (
    r"(?<![A-Za-z0-9])(?:"
    r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*+"
    r"|(?<![A-Za-z0-9_\-])(?i:[a-z0-9_\-]*(?:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key))\s{0,2}[=:]\s{0,2}[\"']?[^\s\"',;]{4,}[\"']?"
    r"|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
    r"|[+(]{0,2}[0-9](?:[ .()\-]{0,2}[0-9]){6,18}(?![0-9])"
    r"|[A-Za-z]{2,4}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"
    rf"|(?:{KEYS})[A-Za-z0-9_\-]{{12,}}+"
    r"|(?<![A-Za-z0-9_\-])(?=[A-Za-z_\-]*+[0-9])[A-Za-z0-9_\-]{16,}+"
    r")"
)
BEFORE = 40
SECRET_WORD = r"(?i)(?:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)\s*[=:]"
#: Gazetteers: mail domains and endings, calling codes, key prefixes, addresses that name no one.
ENDINGS = "com|org|net|edu|gov|info|io|co|biz|me|eu|de|fr|es|it|nl|uk|us|ca|ch|at|be|ru|cn|jp|br|in|au"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|92|98|351|353|358|380|420"
DATE = r"^((1[0-9]|20)[0-9]{2}[.\-][01]?[0-9][.\-][0-3]?[0-9]|[0-3]?[0-9][.\-][01]?[0-9][.\-](1[0-9]|20)[0-9]{2})$"


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda x: x != ""), lambda x: x.cast("int"))
    twice = F.transform(each, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(twice, F.lit(0), lambda s, x: s + x) % 10 == 0


#: kind: what the shape says, and the tag that replaces a private span of it.
KINDS = ("EMAIL", "SECRET", "IP", "SSN", "PHONE", "CARD", "IBAN", "KEY", "NUMBER")


def kind(s: Column) -> Column:
    n = F.length(digits(s))
    return (
        F.when(s.contains("@"), 0).when(s.rlike(SECRET_WORD), 1).when(s.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), 2).when(s.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 3)
        .when(s.rlike("[A-Za-z]"), F.when(s.rlike(r"^[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,}"), 6).otherwise(7))
        .when(s.rlike(DATE), 8).when((n >= 13) & s.rlike(r"^[0-9][0-9 \-]+$"), 5).when(s.rlike(r"^[+(]") | s.rlike(r"^[0-9]{2,4}[ .\-][0-9]"), 4).otherwise(8)
    )


def labelers(s: Column, before: Column) -> list[tuple[Column, Column]]:
    """(votes for private, votes against) of each labeler; it abstains where neither holds."""
    no, n = F.lit(False), F.length(digits(s))
    octets = F.split(s, r"\.")
    ip = s.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    octet = F.forall(octets, lambda x: F.coalesce(F.try_to_number(x, F.lit("999")).cast("int") <= 255, F.lit(False)))
    card = s.rlike(r"^[0-9](?:[ \-]?[0-9]){12,18}$")
    entropy = F.size(F.array_distinct(F.split(s, "")))
    return [
        # patterns
        (s.rlike(r"^[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*+$") & s.rlike(r"\.[A-Za-z]{2,}$"), s.contains("@") & ~s.rlike(r"\.[A-Za-z]{2,}$")),
        (ip & octet, ip & ~octet),
        (card & luhn(digits(s)), card & ~luhn(digits(s))),
        (s.rlike(r"^\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?([ .\-]?[0-9]{2,4}){2,4}$") | s.rlike(r"^\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}$"), no),
        (s.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), s.rlike(r"^(000|666|9[0-9]{2})-[0-9]{2}-[0-9]{4}$")),
        (s.rlike(SECRET_WORD), no),
        (s.rlike(r"^[A-Za-z0-9_\-]{16,}$") & s.rlike("[A-Za-z]") & (n >= 2) & (entropy >= 10), s.rlike(r"^[A-Za-z0-9_\-]{16,}$") & (entropy < 7)),
        # gazetteers
        (s.contains("@") & s.rlike(rf"\.(?:{ENDINGS})$"), no),
        (s.rlike(rf"^\+({CALLING})[ .(\-]"), no),
        (card & s.rlike(r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)"), no),
        (s.rlike(rf"^({KEYS})"), no),
        (no, s.rlike(r"^(127\.0\.0\.1|0\.0\.0\.0|255\.255\.255\.[0-9]+)$")),
        # context
        (before.rlike(r"(?i)(e-?mail|mail|contact|write to|call|phone|tel|fax|mobile|ip|host|address|card|visa|ssn|iban|account|login|user|password|token|secret|key)\W{0,4}$"), no),
        (no, before.rlike(r"(?i)(version|isbn|issn|doi|section|figure|fig|table|page|pp|chapter|release|build|rev|vol|no|nr)\W{0,3}$")),
        (no, s.rlike(DATE) | s.rlike(r"^[0-9]{1,9}$") | (F.length(digits(s)) < 7) & ~s.rlike("[A-Za-z]")),
    ]


LABELERS = 15


def code(span: Column, before: Column) -> Column:
    """All that voting and classifying use of a span, in one long: the kind, then two bits a labeler."""
    out = kind(span).cast("long")
    for k, (for_, against) in enumerate(labelers(span, before)):
        vote = F.when(F.coalesce(for_, F.lit(False)), 1).when(F.coalesce(against, F.lit(False)), 2).otherwise(0).cast("long")
        out = out + F.shiftleft(vote, 4 + 2 * k)
    return out


def spans(text: Column) -> Column:
    """array<struct(span, before, code)> of a text in order."""
    found = F.regexp_extract_all(text, F.lit(SPAN), F.lit(0))
    pieces = F.split(text, SPAN, -1)
    both = F.zip_with(found, pieces, lambda s, p: F.struct(s.alias("span"), p.alias("piece")))
    coded = F.transform(F.filter(both, lambda x: x["span"].isNotNull()), lambda x: let(F.struct(x["span"].alias("s"), F.right(x["piece"], F.lit(BEFORE)).alias("b")), lambda y: F.struct(x["span"].alias("span"), code(y["s"], y["b"]).alias("code"))))
    return F.when(hinted(text), coded).otherwise(F.array().cast("array<struct<span:string,code:bigint>>"))


def unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds, and votes of +1, -1 and 0."""
    raw = (codes[:, None] >> (4 + 2 * np.arange(LABELERS))) & 3
    return codes & 15, np.where(raw == 1, 1, np.where(raw == 2, -1, 0))


#: Chance of a span without any vote to be private.
PRIOR = 0.4


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Each labeler's chance to be right when it votes, and each pattern's chance to be private, by expectation-maximisation.

    A vote is right or wrong with one chance a labeler. That chance is learnt from the spans where other labelers
    vote too, beside 8 right and 2 wrong votes beforehand; spans of a single vote say nothing about the labeler, so
    one that always votes alone stays as good as supposed. The chance before any vote is PRIOR, not the share of private
    spans: where nearly all candidates are private, a lone vote against one must still count."""
    right = np.full(votes.shape[1], 0.8)
    start = np.log(PRIOR / (1 - PRIOR))
    others = (votes != 0).sum(axis=1)[:, None] - (votes != 0) > 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(start + (votes * np.log(right / (1 - right))).sum(axis=1))))
        weight = counts[:, None] * ((votes != 0) & others)
        agree = (weight * np.where(votes == 1, p[:, None], 1 - p[:, None])).sum(axis=0)
        now = np.clip((agree + 8) / (weight.sum(axis=0) + 10), 0.05, 0.99)
        moved, right = np.abs(now - right).max(initial=0), now
        if moved < 1e-9:
            break
    return right, 1 / (1 + np.exp(-(start + (votes * np.log(right / (1 - right))).sum(axis=1))))


def classifier(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, target: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Probabilities of a logistic regression on kinds and votes, fit to soft targets by Newton's method.

    A pattern weighs by the logarithm of its count, so that the ridge doesn't drown kinds that are rare beside others."""
    x = np.concatenate([np.ones((len(kinds), 1)), kinds[:, None] == np.arange(len(KINDS)), votes == 1, votes == -1], axis=1).astype(float)
    w = np.zeros(x.shape[1])
    scale = 1 + np.log(counts)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (scale * (p - target)) + ridge * w
        step = np.linalg.solve((x * (scale * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def private_codes(docs: DataFrame) -> list[int]:
    """The codes whose spans are private, learnt from every span of all documents; the driver gets a row a distinct code."""
    rows = docs.select(F.explode(spans(F.col("text"))).alias("s")).groupBy("s.code").count().collect()
    if not rows:
        return []
    codes, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    kinds, votes = unpack(codes)
    _, p = reliabilities(votes, counts)
    return codes[classifier(kinds, votes, counts, p) >= 0.5].tolist()


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with private spans of ``text`` replaced by their kind, as in <EMAIL>, and ``pii_spans`` (int), how many.

    Spans found by SPAN get the votes of regex, gazetteer and context labelers. Votes of all spans of all
    documents are counted by pattern; expectation-maximisation on the counts gives reliabilities and soft
    labels, on which the span classifier is trained; spans it holds at least as likely private as not go. Equal
    spans after equal words are treated alike, so repeated rows agree. A null text stays null and an empty one
    empty, with 0 spans; ids aren't looked at; a column named pii_spans is replaced and all others stay. No rows
    give none."""
    codes = private_codes(docs)
    (a,) = fresh(docs, "spans_")
    with_spans = docs.withColumn(a, spans(F.col("text")))
    found = F.col(f"`{a}`")
    bad = (lambda c: c.isin(codes)) if codes else (lambda c: F.lit(False))
    tags = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    new = F.transform(found, lambda x: F.when(bad(x["code"]), F.get(tags, x["code"].bitwiseAND(F.lit(15)).cast("int"))).otherwise(x["span"]))
    pieces = F.split(F.col("text"), SPAN, -1)
    n = F.coalesce(F.size(F.filter(found, lambda x: bad(x["code"]))), F.lit(0))
    whole = F.array_join(F.flatten(F.zip_with(pieces, new, lambda p, x: F.array(p, F.coalesce(x, F.lit(""))))), "")
    text = F.when(n > 0, whole).otherwise(F.col("text"))
    cols = [text.alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() != "pii_spans"]
    return with_spans.select(*cols, n.alias("pii_spans"))
