"""Text features as column expressions; no Python runs per row.

Java's ``\\s``, ``\\w`` and ``\\b`` are ASCII unless ``(?U)``; ``(?d)`` keeps LF as
the only line end. Patterns over ASCII classes need neither.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siltseek.functions import lexicon as L


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(_col(text), r"(?U)\A\s+|(?<!\s)\s+\z", "")


def universal_newlines(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"\r\n?", "\n")


def rstrip_lines(text: Column | str) -> Column:
    """Each line without white space at its end; tried only where a run begins."""
    return F.regexp_replace(_col(text), r"(?U)(?<![\s&&[^\n]])[\s&&[^\n]]++(?=\n|\z)", "")


def words(text: Column | str) -> Column:
    """Lower-cased ASCII words that start with a letter."""
    return F.transform(_all(_col(text), L.WORD), F.lower)


def split_identifier(name: Column | str) -> Column:
    """Lower-cased parts of a snake_case or camelCase name."""
    marked = F.regexp_replace(_col(name), L.CAMEL_BOUNDARY, "_")
    return F.transform(F.filter(F.split(marked, "_"), lambda p: p != ""), F.lower)


def normalise_ws(text: Column | str) -> Column:
    """LF line ends, single blanks, at most one empty line, nothing at the ends."""
    t = F.regexp_replace(universal_newlines(text), r"[ \t]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def query_views(text: Column | str) -> Column:
    """STRUCT<full, statement>: the question without examples, and its narrative.

    Dashed section lines part the text; without any, plain ones do; without
    either both views are the cleaned text. A null text is empty.
    """
    t = normalise_ws(F.coalesce(_col(text), F.lit("")))
    dashed, plain = "(?imdU)" + L.DASHED_SECTION, "(?mdU)" + L.PLAIN_SECTION

    def cut(pattern: str) -> Column:
        parts = F.split(t, pattern, -1)
        before = strip(F.element_at(parts, 1))
        statement = F.when(before == "", t).otherwise(before)
        bodies = F.zip_with(_all(t, pattern, 1), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda n, b: F.when(F.lower(n).isin(L.KEPT_SECTIONS), strip(b)).otherwise(F.lit("")))
        kept = F.concat(F.array(statement), F.filter(bodies, lambda b: b != ""))
        return F.struct(normalise_ws(F.array_join(kept, "\n\n")).alias("full"), statement.alias("statement"))

    whole = F.struct(t.alias("full"), t.alias("statement"))
    return F.when(F.regexp_like(t, F.lit(dashed)), cut(dashed)).when(F.regexp_like(t, F.lit(plain)), cut(plain)).otherwise(whole)


def stem(word: Column | str) -> Column:
    w = _col(word)
    out = None
    for suffix, new in L.STEM_SUFFIXES:
        fits = w.endswith(suffix) & (F.length(w) >= len(suffix) + L.STEM_LEAST)
        value = F.concat(F.substring(w, F.lit(1), F.length(w) - len(suffix)), F.lit(new))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(w)


def _table() -> Column:
    pairs: list[Column] = []
    for word, terms in L.NL_TO_CODE.items():
        pairs += [F.lit(word), F.array(*[F.lit(t) for t in terms])]
    return F.create_map(*pairs)


def query_terms(text: Column | str) -> Column:
    """The bag of a question's content words, the code words for them, and stems."""
    table = _table()

    def emit(w: Column) -> Column:
        code = F.coalesce(F.element_at(table, w), F.array().cast("array<string>"))
        stemmed = stem(w)
        return F.concat(F.array(w), code, F.when(stemmed != w, F.array(stemmed)).otherwise(F.array().cast("array<string>")))

    content = F.filter(words(text), lambda w: ~w.isin(L.STOPWORDS) & (F.length(w) >= 2))
    return F.flatten(F.transform(content, emit))


def clean_code(code: Column | str, max_chars: int = 6000) -> Column:
    """Code with plain white space; a long one keeps its head (65 %) and its tail."""
    t = F.replace(universal_newlines(F.coalesce(_col(code), F.lit(""))), F.lit("\t"), F.lit("    "))
    t = strip(F.regexp_replace(rstrip_lines(t), r"\n{3,}", "\n\n"))
    head = int(max_chars * 0.65)
    cut = F.concat(F.substring(t, 1, head), F.lit("\n...\n"), F.substring(t, -(max_chars - head), max_chars - head))
    return F.when(F.length(t) <= max_chars, t).otherwise(cut)


def comments_and_strings(code: Column | str) -> Column:
    """Block comments, string literals, then what follows the first # or // of each line."""
    c = _col(code)
    found = F.concat(_all(c, "(?s)" + L.BLOCK_COMMENT), _all(c, "(?s)" + L.STRING_LITERAL, 1), _all(c, "(?md)" + L.LINE_COMMENT, 2))
    return F.array_join(found, "\n")


def code_terms(code: Column | str) -> Column:
    """The bag of a snippet's names, their parts, and the words of its comments."""
    c = F.coalesce(_col(code), F.lit(""))
    none = F.array().cast("array<string>")
    means = lambda w: ~w.isin(L.CODE_NOISE) & (F.length(w) > 1)

    def emit(name: Column) -> Column:
        low, parts = F.lower(name), split_identifier(name)
        own = F.when(means(low), F.array(low)).otherwise(none)
        split = (F.size(parts) > 1) | ((F.size(parts) == 1) & (F.try_element_at(parts, F.lit(1)) != low))
        # a name without a boundary is its own only part: most are, and are done here
        return F.when(F.regexp_like(name, F.lit(f"_|{L.CAMEL_BOUNDARY}")), F.concat(own, F.when(split, F.filter(parts, means)).otherwise(none))).otherwise(own)

    said = F.filter(words(comments_and_strings(c)), lambda w: ~w.isin(L.STOPWORDS) & (F.length(w) > 1))
    return F.concat(F.flatten(F.transform(_all(c, L.IDENTIFIER), emit)), said)


def content_hash(text: Column | str) -> Column:
    """16 hex digits that ignore white space at line ends and around the text."""
    return F.substring(F.sha1(rstrip_lines(strip(text))), 1, 16)


def cache_key(model: str, kind: str, text: Column | str) -> Column:
    return F.sha1(F.concat(F.lit(f"{model}|{kind}|"), _col(text)))


def prefixed(text: Column | str, kind: str, query_prefix: str = "", doc_prefix: str = "") -> Column:
    return F.concat(F.lit(query_prefix if kind.startswith("query") else doc_prefix), _col(text))


def with_instruction(text: Column | str, instruction: Column | str) -> Column:
    i = _col(instruction)
    return F.when(F.coalesce(i, F.lit("")) != "", F.concat_ws(" ", _col(text), i)).otherwise(_col(text))


def with_title(title: Column | str, text: Column | str) -> Column:
    body = F.coalesce(_col(text), F.lit(""))
    return F.when(F.coalesce(_col(title), F.lit("")) != "", strip(F.concat_ws(" ", _col(title), body))).otherwise(body)


def preview(text: Column | str, lines: int = 4, width: int = 100) -> Column:
    """The first lines that aren't blank, each cut to ``width``."""
    solid = F.filter(F.split(_col(text), "\n", -1), lambda x: strip(x) != "")
    return F.array_join(F.transform(F.slice(solid, 1, lines), lambda x: F.concat(F.lit("      | "), F.substring(x, 1, width))), "\n")
