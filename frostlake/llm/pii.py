"""Personal data: spans proposed by regular expressions, confirmed by validators, scored with their context.

Everything is a DataFrame expression; nothing is shuffled. A kind's matches are leftmost and do not overlap
each other; a match that its validator refuses is dropped and not tried again at another place. Places come
from the lengths of the stretches between matches. A kind has a score of its own, and words near a span
raise it; a span counts when the score is at least LEAST. The base kinds' own scores are, so their
validated spans always stay; numbers of insured persons and secrets count only where words say what they are.

Defined cases: a null text is an empty text, without spans; spans of different kinds may overlap and are
all told; places are code points, the end exclusive; repeated identifiers are rows of their own; an
empty table gives no rows; further columns are left alone, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostlake.llm.common import text_of

LEAST = 0.5
#: Code points before and after a span in which words count as near.
NEAR = 48


@dataclass(frozen=True)
class Kind:
    name: str
    #: Finds what the contract's pattern finds: runs are taken whole (they cannot give anything back to advantage), and a
    #: search starts at a run's beginning or where the last match ended, so that long runs take linear time.
    pattern: str
    score: float
    #: What the text must hold for the pattern to be worth a try.
    sign: str
    valid: str = "true"
    words: str = ""
    gain: float = 0.0


_LUHN = """aggregate(sequence(1, length(d)), 0, (a, i) -> a + (CASE WHEN i % 2 = 1 THEN int(substring(d, length(d) - i + 1, 1))
    WHEN int(substring(d, length(d) - i + 1, 1)) > 4 THEN 2 * int(substring(d, length(d) - i + 1, 1)) - 9
    ELSE 2 * int(substring(d, length(d) - i + 1, 1)) END)) % 10 = 0"""
#: Letters count as 10 to 35, the first four characters go to the end; the remainder must be 1.
_MOD97 = """aggregate(transform(sequence(1, length(d)), i -> ascii(substring(concat(substring(d, 5), substring(d, 1, 4)), i, 1))), 0,
    (a, c) -> CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1"""


def _with(digits: str, test: str) -> str:
    """test over d, which is worked out once."""
    return f"exists(array({digits}), d -> {test})"


#: Lengths of account numbers by country, so that what follows a number is not taken for a part of it. Other
#: countries' numbers are taken as long as they go.
_IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in _IBAN.items())
_CODES = "|".join(_IBAN.values()).replace(" ", "|")

#: The base kinds in the order of the contract, then those that the method adds.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "contains(text, '@')", words=r"mail|contact", gain=0.1),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "rlike(text, '[0-9]\\\\.[0-9]')", "forall(split(m, '[.]'), x -> coalesce(try_cast(x AS int) <= 255, false))", r"\bip\b|address|host|server", 0.3),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, "rlike(text, '[0-9][\\\\x20-]?[0-9]')", _with("regexp_replace(m, '[^0-9]', '')", f"length(d) BETWEEN 14 AND 19 AND {_LUHN}"), r"card|visa|credit|payment", 0.2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "contains(text, '+')", "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 10 AND 15", r"phone|tel|call|mobile", 0.3),
)
ADDED = (
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_LISTED}|(?!{_CODES})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])", 0.7, "rlike(text, '[A-Z]{2}[0-9]{2}')", _with("replace(m, ' ', '')", f"length(d) BETWEEN 15 AND 34 AND {_MOD97}"), r"iban|account|bank|konto|compte|cuenta", 0.3),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "rlike(text, '[0-9]-[0-9]')", "NOT rlike(m, '^(000|666|9..)|-00-|0000$')", r"\bssn\b|social.security", 0.5),
    # A long run of letters and digits, as random ones are: of many different characters.
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", 0.3, "rlike(text, '[A-Za-z0-9_-]{20}')", "rlike(m, '[0-9]') AND rlike(m, '[A-Za-z]') AND size(array_distinct(split(m, ''))) >= 9", r"token|secret|api.?key|access.?key|passw|bearer|credential", 0.5),
)
KINDS = BASE + ADDED

#: Running sums in blocks, so that a text with very many matches takes neither quadratic time nor a shuffle.
_BLOCK = 256


def _running(lengths: str) -> str:
    """The sums before each element of an array, as an array of one element more."""
    blocks = f"transform(sequence(0, size({lengths}) div {_BLOCK}), b -> slice({lengths}, b * {_BLOCK} + 1, {_BLOCK}))"
    inner = "aggregate({0}, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    totals = f"transform({blocks}, p -> aggregate(p, 0, (a, x) -> a + x))"
    before = inner.format(totals)
    return f"flatten(zip_with({blocks}, slice({before}, 1, size({blocks})), (p, s) -> transform(slice({inner.format('p')}, 1, {_BLOCK}), x -> x + s)))"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: Kind, rank: int) -> Column:
    """The kind's confirmed spans, from its matches (m_) and the starts of them (s_)."""
    near = f"lower(concat(substring(text, greatest(1, z.s + 1 - {NEAR}), least({NEAR}, z.s)), ' ', substring(text, z.s + length(z.m) + 1, {NEAR})))"
    gain = f"IF(rlike({near}, {_literal(kind.words)}), {kind.gain}D, 0D)" if kind.words else "0D"
    found = f"filter(zip_with(m_{kind.name}, s_{kind.name}, (m, s) -> named_struct('m', m, 's', s)), z -> {kind.valid.replace('(m,', '(z.m,')})"
    made = f"transform({found}, z -> struct(z.s AS start, {rank} AS rank, '{kind.name}' AS kind, z.s + length(z.m) AS end, least(1D, {kind.score}D + {gain}) AS score))"
    return F.expr(f"IF(size(m_{kind.name}) = 0, array(), filter({made}, z -> z.score >= {LEAST}D))")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(id, text, spans) of every row; spans are (start, rank, kind, end, score) by start, then as the kinds are listed."""
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    matches = [F.expr(f"IF({k.sign}, regexp_extract_all(text, {_literal(k.pattern)}, 0), array())").alias(f"m_{k.name}") for k in kinds]
    rows = rows.select("id", "text", *matches)
    # Each match begins after all stretches up to it and all matches before it.
    gaps = [F.expr(f"IF(size(m_{k.name}) = 0, array(), zip_with(slice(split(text, {_literal(k.pattern)}, -1), 1, size(m_{k.name})), concat(array(''), slice(m_{k.name}, 1, size(m_{k.name}) - 1)), (g, m) -> length(g) + length(m)))").alias(f"g_{k.name}") for k in kinds]
    rows = rows.select("*", *gaps)
    # The running sum up to and with its own gap is where a match starts.
    starts = [F.expr(f"IF(size(m_{k.name}) = 0, array(), {_running(f'g_{k.name}')})").alias(f"b_{k.name}") for k in kinds]
    rows = rows.select("*", *starts)
    rows = rows.select("id", "text", *[f"m_{k.name}" for k in kinds], *[F.expr(f"zip_with(slice(b_{k.name}, 1, size(g_{k.name})), g_{k.name}, (b, g) -> b + g)").alias(f"s_{k.name}") for k in kinds])
    found = [_spans(k, i) for i, k in enumerate(kinds)]
    return rows.select(F.col("id").alias(id_col), "text", F.array_sort(F.concat(*found)).alias("spans"))


def told(spans: Column, names: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, joined by commas."""
    wanted = F.filter(spans, lambda z: z["kind"].isin(*names)) if names else spans
    return F.array_join(F.transform(wanted, lambda z: F.concat_ws(":", z["kind"], z["start"].cast("string"), z["end"].cast("string"))), ",")


def redact(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text) with every span replaced by its kind in brackets; of spans that overlap the first one's
    kind is written and all of them go."""
    step = "(a, z) -> IF(z.start >= a.at, named_struct('at', z.end, 'out', concat(a.out, array(substring(text, a.at + 1, z.start - a.at), concat('[', upper(z.kind), ']')))), named_struct('at', greatest(a.at, z.end), 'out', a.out))"
    text = F.expr(f"aggregate(spans, named_struct('at', 0, 'out', CAST(array() AS array<string>)), {step}, a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))")
    return found.select(F.col(id_col), text.alias("text"))
