"""Text columns: cleaning, terms, keywords, segments, token estimates, previews, templates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python strings see it, as the inside of a Java character class (Java's own \s is ASCII only).
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CJK = r"\u3400-\u4dbf\u4e00-\u9fff"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def _normal_form(form: str) -> Column:
    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return F.pandas_udf(f, "string")


def unicode_normal(c: Column | str, form: str = "NFC") -> Column:
    """Spark has no built-in for this; plain ASCII rows don't change, and only the others need Python."""
    return F.when(col(c).rlike(r"^\p{ASCII}*$"), col(c)).otherwise(_normal_form(form)(col(c)))


def casefold(c: Column | str) -> Column:
    def f(texts: pd.Series) -> pd.Series:
        return texts.map(str.casefold, na_action="ignore")

    return F.when(col(c).rlike(r"^\p{ASCII}*$"), F.lower(col(c))).otherwise(F.pandas_udf(f, "string")(col(c)))


#: Steps of clean_text: the action's name, and what it does.
CLEANING = (
    ("normalize_newlines", lambda t: F.regexp_replace(t, r"\r\n?", "\n")),
    ("replace_non_breaking_space", lambda t: F.replace(t, F.lit("\u00a0"), F.lit(" "))),
    ("normalize_unicode_nfc", unicode_normal),
    ("trim_line_endings", lambda t: F.regexp_replace(t, rf"[{SPACE}&&[^\n]]+(?=\n|$(?!\n))", "")),
    ("collapse_blank_lines", lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n")),
    ("trim_outer_whitespace", strip),
)


def clean_steps(c: Column | str, without: tuple[str, ...] = ()) -> list[tuple[str, Column]]:
    """The text after each cleaning step, first to last."""
    out, text = [], col(c)
    for name, step in CLEANING:
        if name not in without:
            text = step(text)
            out.append((name, text))
    return out


def clean_text(df, c: str, text: str = "cleaned", actions: str = "actions", without: tuple[str, ...] = ()):
    """df with the cleaned text and the names of the steps that changed something. Each step is a column, computed once."""
    before, names, steps = c, [], []
    for i, (name, step) in enumerate(s for s in CLEANING if s[0] not in without):
        df = df.withColumn(f"__step{i}", step(F.col(before)))
        names.append(F.when(F.col(f"__step{i}") != F.col(before), F.lit(name)))
        before = f"__step{i}"
        steps.append(before)
    return df.withColumn(text, F.col(before)).withColumn(actions, F.array_compact(F.array(*names))).drop(*steps)


def normalize_text(c: Column | str) -> Column:
    """No byte-order marks, \\n for line ends, no white space at the end of lines or around the text."""
    t = F.regexp_replace(F.replace(col(c), F.lit("\ufeff"), F.lit("")), r"\r\n?", "\n")
    return strip(F.regexp_replace(t, rf"[{SPACE}&&[^\n]]+(?=\n|$(?!\n))", ""))


def without_space(c: Column | str) -> Column:
    """Content key: no white space, lower case."""
    return F.lower(F.regexp_replace(col(c), rf"[{SPACE}]+", ""))


def one_line(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), rf"[{SPACE}]+", " "))


def preview(c: Column | str, limit: int = 120, dots_inside: bool = False) -> Column:
    """One line of at most limit characters and dots (inside the limit, if asked)."""
    t = one_line(c)
    kept = limit - 3 if dots_inside else limit
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, kept)) if dots_inside else F.substring(t, 1, kept), F.lit("..."))).otherwise(t)


SEGMENT = rf"[A-Za-z][A-Za-z0-9_./:+#%-]*|\d+(?:\.\d+)*|[{CJK}]+"
TECHNICAL = r"^(?:[a-z][a-z0-9]*(?:[_.:/+#%-][a-z0-9]+)+|[a-z]+\d+|\d{3,})$"
#: Fixed stop terms.
STOP_TERMS = ("的", "了", "吗", "呢", "请问", "什么", "时候", "如何", "怎么", "是否")


def is_cjk(c: Column | str) -> Column:
    return col(c).rlike(rf"^[{CJK}]+$")


def cjk_bigrams(c: Column) -> Column:
    """Pairs of neighbouring characters; one character alone is itself. The default segmenter of CJK runs."""
    n = F.length(c)
    return F.when(n <= 1, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def lexical_terms(normalized: Column | str, stop_terms: tuple[str, ...] = STOP_TERMS, segmenter=cjk_bigrams, dictionary=None) -> Column:
    """Terms of a normalised text, with repeats: identifiers, numbers and CJK segments without stop terms; after a technical one its sentinel.

    dictionary: a segmentation.Dictionary, whose search terms CJK runs become; without one the segmenter cuts them.
    """
    stops = F.array(*[F.lit(s) for s in stop_terms])

    def of(s: Column, cut: Column | None = None) -> Column:
        plain = F.when(F.array_contains(stops, s), F.array().cast("array<string>")).otherwise(F.array(s))
        sentinel = F.when(s.rlike(TECHNICAL), F.array(F.concat(F.lit("techid"), F.regexp_replace(s, "[^a-z0-9]+", "")))).otherwise(F.array().cast("array<string>"))
        return F.when(is_cjk(s), F.filter(segmenter(s) if cut is None else cut, lambda t: ~F.array_contains(stops, t))).otherwise(F.concat(plain, sentinel))

    found = F.regexp_extract_all(col(normalized), F.lit(SEGMENT), F.lit(0))
    if dictionary is None:
        return F.flatten(F.transform(found, lambda s: of(s)))
    runs = F.transform(found, lambda s: F.when(is_cjk(s), s).otherwise(F.lit("")))
    both = F.arrays_zip(found.alias("s"), dictionary.column(runs).alias("cut"))
    return F.flatten(F.transform(both, lambda x: of(x["s"], x["cut"])))


def query_terms(normalized: Column | str, **kw) -> Column:
    return F.array_distinct(lexical_terms(normalized, **kw))


def websearch(terms: Column | str, operator: str = "or") -> Column:
    """Quoted terms, joined by OR or a space."""
    return F.array_join(F.transform(col(terms), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR " if operator == "or" else " ")


def phrases(terms: Column | str) -> Column:
    """What the index splits each term into again, kept apart by term: identifiers at anything but letters and digits; CJK stays. A quoted term of several must stand as a phrase."""
    return F.transform(col(terms), lambda t: F.filter(F.when(t.rlike(rf"[{CJK}]"), F.array(t)).otherwise(F.split(t, r"[^A-Za-z0-9]+")), lambda x: x != ""))


def lexemes(terms: Column | str) -> Column:
    """The terms as the index splits them, one after the other."""
    return F.flatten(phrases(terms))


def bm25_tokens(c: Column | str) -> Column:
    """Characters and pairs of neighbours of the lower-cased text, once white space and CJK punctuation are gone."""
    t = F.regexp_replace(F.lower(col(c)), rf"""[{SPACE}\u3000-\u303f\uff00-\uffef，。！？、；：""''（）【】]+""", "")
    n = F.length(t)
    one = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(t, i, F.lit(1)))
    two = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    empty = F.array().cast("array<string>")
    return F.when(n == 0, empty).when(n == 1, one).otherwise(F.concat(one, two))


#: Fixed terms that say nothing about a requirement.
COMMON_TERMS = ("这个", "需求", "新增", "需要", "进行", "如果", "以及", "相关", "说明", "用户", "系统")


def keywords(c: Column | str) -> Column:
    found = F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"[A-Za-z0-9_./-]+|[\u4e00-\u9fff]{2,8}"), F.lit(0)))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*COMMON_TERMS))


def segments(c: Column | str, longest: int = 120) -> Column:
    """Stripped lines with text; long ones cut after sentence marks."""
    lines = F.transform(F.split(col(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip)
    parts = F.transform(lines, lambda x: F.when(F.length(x) <= longest, F.array(x)).otherwise(F.transform(F.split(x, r"(?<=[。；;.!?？])"), strip)))
    return F.filter(F.flatten(parts), lambda x: x != "")


def segment_score(segment: Column | str, words: Column | str) -> Column:
    return F.size(F.filter(col(words), lambda w: F.contains(col(segment), w)))


def sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), rf"(?<=[。！？.!?])[{SPACE}]+|\n+"), strip), lambda x: x != "")


def estimate_tokens(c: Column | str) -> Column:
    """Half the characters of the stripped text, one at least; blank is 0. The named proxy where no vocabulary is at hand."""
    n = F.length(strip(c))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 2))).cast("long")


def estimate_tokens_mixed(c: Column | str) -> Column:
    """A quarter of the ASCII characters, two thirds of the others; each one at least where there are any."""
    plain = F.length(F.regexp_replace(col(c), r"[^\x00-\x7F]", ""))
    other = F.length(col(c)) - plain
    of_plain = F.when(plain > 0, F.greatest(F.lit(1), F.floor(plain / 4))).otherwise(0)
    of_other = F.when(other > 0, F.greatest(F.lit(1), F.floor(other / 1.5))).otherwise(0)
    return (of_plain + of_other).cast("long")


def source_labels(c: Column | str) -> Column:
    """Labels like [S3] in the order they first stand."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"\[(S\d+)\]"), F.lit(1)))


def lexical_overlap(question: Column | str, text: Column | str) -> Column:
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    q = words(question)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(text))) / F.size(q)).otherwise(0.0)


def render_template(template: Column | str, variables: dict[str, Column]) -> Column:
    """{{ name }} replaced; variables that aren't given become empty."""
    out = col(template)
    for name, value in variables.items():
        out = F.replace(F.regexp_replace(out, rf"\{{\{{\s*{name}\s*\}}\}}", "\ue000"), F.lit("\ue000"), F.coalesce(value, F.lit("")))
    return F.regexp_replace(out, r"\{\{\s*[A-Za-z_]\w*\s*\}\}", "")


def template_variables(template: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(template), F.lit(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}"), F.lit(1))))


def template_audit(template: Column | str, given: Column | str) -> Column:
    declared = template_variables(template)
    return F.struct(declared.alias("declared"), F.array_sort(F.array_except(declared, col(given))).alias("missing"), F.array_sort(F.array_except(col(given), declared)).alias("unused"))


def pick_label(answer: Column | str, labels: tuple[str, ...]) -> Column:
    """The first of the labels in an answer without white space; else its first 20 characters, or EMPTY."""
    t = F.regexp_replace(col(answer), rf"[{SPACE}]+", "")
    out = F.when(t == "", "EMPTY").otherwise(F.substring(t, 1, 20))
    for label in reversed(labels):
        out = F.when(F.contains(t, F.lit(label)), label).otherwise(out)
    return out


def context_block(source_id: Column, title: Column, kind: Column, score: Column, metadata: Column, content: Column) -> Column:
    """A context source as a prompt shows it."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    head = F.concat(F.lit("["), source_id, F.lit("] "), F.coalesce(F.when(title != "", title), kind))
    lines = F.array(head, F.concat(F.lit("type: "), kind), F.when(score.isNotNull(), F.concat(F.lit("score: "), F.format_string("%.2f", score))), F.when(F.size(metadata) > 0, F.concat(F.lit("metadata: "), pairs)), content)
    return strip(F.array_join(F.array_compact(lines), "\n"))


def log_fields(line: Column | str) -> Column:
    """time, level and message of a line like 2024-01-31 12:00:00 INFO text."""
    pattern = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) +(\w+) +(.*)$"
    return F.struct(F.try_to_timestamp(F.nullif(F.regexp_extract(col(line), pattern, 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss")).alias("time"), F.nullif(F.regexp_extract(col(line), pattern, 2), F.lit("")).alias("level"), F.nullif(F.regexp_extract(col(line), pattern, 3), F.lit("")).alias("message"))


def stream_pieces(c: Column | str, sizes: tuple[int, ...] = (4, 5, 3, 6)) -> Column:
    """The text cut in pieces whose sizes repeat."""
    total = sum(sizes)
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    rounds = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(col(c)) / total), F.lit(1)).cast("int") - 1)
    cut = F.flatten(F.transform(rounds, lambda r: F.array(*[F.substring(col(c), r * total + s + 1, F.lit(n)) for s, n in zip(starts, sizes, strict=True)])))
    return F.filter(cut, lambda x: x != "")
