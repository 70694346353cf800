"""Column functions on texts: cleaning, clause attributes, tokens, labels, formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

#: White space as Python strips it, which trim() does not.
_WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Flags: dot matches all, ^ and $ at lines, only \n ends a line.
DOTALL_LINES = "(?smd)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{_WHITE}+|{_WHITE}+\z", "")


def clean_lines(c: Column) -> Column:
    """Without publisher lines and running headers, three or more newlines as two."""
    # fixed values: the publisher's line and the running header
    for pattern, to in ((r"ETSI\s*\n", "\n"), (r"ETSI EN \d+ \d+ V[\d.]+ \(\d{4}-\d{2}\)\s*\n", "\n"), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return c


def clean_text(c: Column) -> Column:
    """clean_lines(), stripped."""
    return strip(clean_lines(c))


# fixed values: the marker of the annex that is cut off, and the offset from which on; the default words below
MARKER, MARKER_AFTER = "\nAnnex B", 50_000


def cut_at_marker(c: Column, marker: str = MARKER, after: int = MARKER_AFTER) -> Column:
    """The text before the first marker at or after an offset in characters; all of it without one."""
    at = F.locate(marker, c, after + 1)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)


def trim_explanations(c: Column, words: Sequence[str] = ("NOTE", "EXAMPLE")) -> Column:
    """Without what follows a line that begins with one of words, white space, a number or none, and a colon."""
    return strip(F.regexp_replace(c, rf"(?s)\n({'|'.join(words)})\s+\d*:.*", ""))


def is_void(c: Column, line: str = r"[Vv]oid\.?", head: str = "Void", within: int = 20) -> Column:
    """Is a line nothing but the void mark, or does it stand among the first characters?"""
    return c.rlike(rf"(?md)^\s*{line}\s*$") | F.substring(c, 1, within).contains(head)


def modality(c: Column, cues: Sequence[str] = ("shall", "should", "may"), default: str = "unknown") -> Column:
    """The first cue contained in the text."""
    low, out = F.lower(c), F
    for cue in cues:
        out = out.when(low.contains(cue), cue)
    return out.otherwise(default)


def section_of(c: Column, parts: int = 2, first: str = "5") -> Column:
    """The leading numbers of a clause id, as 5.1 of 5.1-2."""
    return F.regexp_extract(c, rf"^({first}" + r"\.\d+" * (parts - 1) + ")", 1)


def word_runs(c: Column, least: int = 1) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"([\p{{L}}\p{{N}}_]{{{least},}})"), 1)


def keywords(c: Column, vocabulary: Sequence[str]) -> Column:
    """Sorted distinct words of the vocabulary that stand alone in the text."""
    words = F.filter(word_runs(c), lambda w: w.rlike("^[a-z]{3,}$"))
    return F.array_sort(F.array_intersect(words, F.array(*map(F.lit, vocabulary)).cast("array<string>")))


def label_of(score: Column, cuts: Sequence[tuple[float, str]]) -> Column:
    """The label of the first bound that the score reaches."""
    out = F
    for bound, label in cuts:
        out = out.when(score >= bound, label)
    return out.otherwise(S.NO_RELATION)


def merged_label(c: Column) -> Column:
    """Both kinds of subsumption as one."""
    return F.when(c.isin("SUBSUMPTION_A_BROADER", "SUBSUMPTION_B_BROADER"), S.SUBSUMPTION).otherwise(c)


def parse_label(c: Column, labels: Sequence[str] = S.LABELS) -> Column:
    """The label that an answer is or, in the order of labels, contains."""
    answer = F.upper(strip(c))
    out = F.when(answer.isin(*labels), answer)
    for label in labels:
        out = out.when(answer.contains(label), label)
    return out.otherwise(S.NO_RELATION)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1_of(p: Column, r: Column) -> Column:
    return safe_ratio(2 * p * r, p + r)


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def decimal3(c: Column) -> Column:
    return F.format_string("%.3f", c)


def list_text(c: Column) -> Column:
    """An array of strings as the text of a list, for CSV."""
    return F.when(F.size(c) > 0, F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))).otherwise("[]")


def prompt(template: str, **values: Column) -> Column:
    """A template with {name} places filled in."""
    import re

    parts = [values[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(\w+)\}", template))]
    return F.concat(*parts)


def request(text: Column) -> Column:
    """A generation request with one user message, greedy and with one candidate."""
    message = F.struct(F.lit("user").alias("role"), F.array(F.struct(text.alias("text"))).alias("parts"))
    config = F.struct(F.lit(0).alias("temperature"), F.lit(1).alias("candidate_count"))
    return F.struct(F.array(message).alias("contents"), config.alias("config"))


def response_text(c: Column) -> Column:
    """The text of a stored response: its own, else the joined parts of the first candidate, else empty."""
    schema = "struct<text:string, candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>"
    r = F.from_json(c, schema)
    parts = F.get(r.candidates, F.lit(0)).content.parts
    return F.coalesce(r.text, F.array_join(F.transform(parts, lambda p: F.coalesce(p.text, F.lit(""))), ""), F.lit(""))


def response_embeddings(c: Column) -> Column:
    """The vectors of a stored response, which has one or several."""
    r = F.from_json(c, "struct<embedding:struct<values:array<double>>, embeddings:array<struct<values:array<double>>>>")
    return F.coalesce(F.transform(r.embeddings, lambda e: e["values"]), F.when(r.embedding.isNotNull(), F.array(r.embedding["values"])))


def l2_normalised(v: Column, floor: float = 1e-9) -> Column:
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: x / F.greatest(norm, F.lit(floor)))
