"""Term and pattern matching as Column expressions, and the same as SQL for the checks.

A `Flag` says what is looked for and in which field.  `column` builds the Spark
expression; `sql` writes what DuckDB needs, whose patterns have no look-around: there,
separators are doubled first, so neighbouring terms do not share one.

Vocabularies are looked up, not searched for: a text is cut into words once, and only words
that begin some term are kept (`known_words`).  A term of one word is there if its word is;
a term of several words is searched for only where its first word is there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDLIKE = re.compile(r"[a-z0-9 '-]+")
SPECIAL = re.compile(r"([.^$*+?()\[\]{}|\\&~#])")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once a row."""
    return F.transform(F.array(value), use)[0]


def text_sql(text: str) -> str:
    """A literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(values) -> Column:
    """An array of texts; parsed at one go, where a call for each of hundreds of literals takes seconds."""
    return F.expr(f"array({', '.join(map(text_sql, values))})")


def mapped(table: dict) -> Column:
    """A map from text to text or whole numbers, parsed at one go."""
    return F.expr("map(" + ", ".join(f"{text_sql(k)}, {text_sql(v) if isinstance(v, str) else f'{v}L'}" for k, v in table.items()) + ")")


def one_of(values) -> Column:
    """The condition of `words_in` and `has_word`: a word is one of many, looked up by hash."""
    return F.expr(f"w -> w IN ({', '.join(map(text_sql, values))})")


def words_in(words: Column, values) -> Column:
    return F.call_function("filter", words, one_of(values))


def has_word(words: Column, values) -> Column:
    return F.call_function("exists", words, one_of(values))


def quoted(text: str) -> str:
    """A term as a pattern that both engines read alike."""
    return SPECIAL.sub(r"\\\1", text)


def _split(terms: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """(bounded terms, longest first; substring terms)"""
    bounded = sorted((t for t in dict.fromkeys(terms) if WORDLIKE.fullmatch(t)), key=lambda t: -len(t))
    return bounded, [t for t in dict.fromkeys(terms) if not WORDLIKE.fullmatch(t)]


def bounded_pattern(terms: list[str]) -> str:
    return "(?<![a-z0-9])(?:" + "|".join(map(quoted, terms)) + ")(?![a-z0-9])"


TOKEN = "[a-z0-9]+"


def known_words(text: Column, *vocabularies: tuple[str, ...]) -> Column:
    """The distinct words of lower-case text that a bounded term of the vocabularies begins with."""
    firsts = sorted({re.findall(TOKEN, t)[0] for terms in vocabularies for t in _split(terms)[0]})
    return words_in(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), firsts)


def _single(bounded: list[str]) -> tuple[list[str], list[str]]:
    """(terms of one word, terms of several)"""
    return [t for t in bounded if re.fullmatch(TOKEN, t)], [t for t in bounded if not re.fullmatch(TOKEN, t)]


def _phrase_match(text: Column, words: Column, phrases: list[str]) -> Column:
    return has_word(words, sorted({re.findall(TOKEN, t)[0] for t in phrases})) & text.rlike(bounded_pattern(phrases))


def term_match(text: Column, terms: tuple[str, ...], words: Column | None = None) -> Column:
    """Whether lower-case text holds any of the terms; `words` are its known words."""
    bounded, anywhere = _split(terms)
    words = known_words(text, terms) if words is None else words
    single, phrases = _single(bounded)
    found = [has_word(words, single)] if single else []
    found += [contains_any(text, tuple(anywhere))] if anywhere else []
    found += [_phrase_match(text, words, phrases)] if phrases else []
    return reduce(lambda a, b: a | b, found)


def term_count(text: Column, terms: tuple[str, ...], words: Column | None = None) -> Column:
    """Distinct terms in lower-case text; of overlapping ones the leftmost, then longest."""
    bounded, anywhere = _split(terms)
    words = known_words(text, terms) if words is None else words
    single, phrases = _single(bounded)
    n = F.size(words_in(words, single)) if single else F.lit(0)
    if phrases:
        # terms overlap only where one of several words is there
        every = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(bounded_pattern(bounded)), F.lit(0))))
        n = F.when(_phrase_match(text, words, phrases), every).otherwise(n)
    return reduce(lambda a, t: a + F.contains(text, F.lit(t)).cast("int"), anywhere, n)


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(listed(dict.fromkeys(parts)), lambda p: F.contains(text, p))


def pattern(text: Column, regex: str) -> Column:
    """A pattern without regard to case; letters of all scripts count where it may meet them."""
    wide = "\\w" in regex or not regex.isascii()
    return text.rlike(("(?iuU)" if wide else "(?i)") + regex)


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _doubled(text: str) -> str:
    return re.sub(r"([^a-z0-9])", r"\1\1", text)


@dataclass(frozen=True)
class Flag:
    """kind: terms, count, parts (substrings), regex, or exact (regex, with case)."""

    kind: str
    field: str
    what: tuple[str, ...] | str

    def column(self, words: Column | None = None) -> Column:
        """`words` are the field's known words."""
        text = F.col(self.field)
        match self.kind:
            case "terms":
                return term_match(text, self.what, words)
            case "count":
                return term_count(text, self.what, words)
            case "parts":
                return contains_any(text, self.what)
            case "regex":
                return pattern(text, self.what)
            case "exact":
                return text.rlike(self.what)
        raise ValueError(self.kind)

    def sql(self) -> str:
        if self.kind in ("terms", "count"):
            bounded, anywhere = _split(self.what)
            twice = f"regexp_replace({self.field}, '([^a-z0-9])', '\\1\\1', 'g')"
            regex = _sql("(?:^|[^a-z0-9])(" + "|".join(quoted(_doubled(t)) for t in bounded) + ")(?:$|[^a-z0-9])")
            if self.kind == "terms":
                return "(" + " OR ".join([f"regexp_matches({twice}, {regex})", *(f"contains({self.field}, {_sql(t)})" for t in anywhere)]) + ")"
            return "(" + " + ".join([f"len(list_distinct(regexp_extract_all({twice}, {regex}, 1)))", *(f"contains({self.field}, {_sql(t)})::INT" for t in anywhere)]) + ")"
        if self.kind == "parts":
            return f"regexp_matches({self.field}, {_sql('|'.join(map(quoted, self.what)))})"
        return f"regexp_matches({self.field}, {_sql(('(?i)' if self.kind == 'regex' else '') + self.what)})"
