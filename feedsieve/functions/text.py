"""Text cleaning and checking as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsieve.functions import vocab as V
from feedsieve.functions.matchers import contains_any, quoted

# Characters that stay, what makes a sentence concrete, corrupt strings and their repairs, years, and the labels of model output.
ALLOWED = "Ѐ-ӿԀ-ԯA-Za-z0-9\\s.,!?:;'\"()\\[\\]«»—–\\-%$€£₽₿+/&№*@#°=<>~^|·↑↓→"
CONCRETE = "[0-9$€£₽₿%]|«|»|[A-Za-z]{2,}"
WORD = "[0-9A-Za-zЀ-ӿԀ-ԯ]+"
SENTENCE_END = r"(?<=[.!?])\s+"
CORRUPT = (("Cλυх", "Слух"), ("cλυх", "слух"), ("G00GL", "GOOGL"), ("\\cdot", "·"))
COMMANDS, FRAGMENTS = r"\\[a-zA-Z]+", r"(?U)\b[а-яёА-ЯЁ]+·{3,}"
YEAR = r"\b(19[0-9]{2}|20[0-9]{2})\b"
LABELS = {"prefix": "ПРЕФИКС", "text": "ТЕКСТ", "tickers": "ТИКЕРЫ"}


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def domain(link: Column) -> Column:
    """Lower-case host of a link; empty for what is no link."""
    return F.lower(F.coalesce(F.try_parse_url(link, F.lit("HOST")), F.lit("")))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + V.URLS, "")


def sanitize(text: Column) -> Column:
    """Drops characters of other scripts, and runs of blanks."""
    return strip(F.regexp_replace(F.regexp_replace(text, f"[^{ALLOWED}]", ""), "[ \\t]{2,}", " "))


def strip_forbidden(text: Column) -> Column:
    phrases = "|".join(map(quoted, V.FORBIDDEN))
    return strip(F.regexp_replace(F.regexp_replace(text, f"(?iu)(?:{phrases})", ""), r"\s{2,}", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.split(strip(text), SENTENCE_END), lambda s: strip(s) != "")


def keep_concrete_sentences(text: Column) -> Column:
    """The first sentence, and later ones that name a number, a quote or a Latin word."""
    return strip(F.array_join(F.filter(sentences(text), lambda s, i: (i == 0) | s.rlike(CONCRETE)), " "))


def clean_body(text: Column) -> Column:
    return keep_concrete_sentences(strip_forbidden(sanitize(strip_urls(_filled(text)))))


def clean_artifacts(text: Column) -> Column:
    """Repairs known corrupt strings; drops backslash commands and cut-off word fragments."""
    text = reduce(lambda t, f: F.replace(t, F.lit(f[0]), F.lit(f[1])), CORRUPT, text)
    text = F.regexp_replace(F.regexp_replace(text, COMMANDS, ""), FRAGMENTS, "")
    return strip(F.regexp_replace(text, " {2,}", " "))


def truncate_at_sentence(text: Column, most: int = V.MAX_POST) -> Column:
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(_filled(text) == "", "").when(F.length(text) <= most, text).when(cut != "", F.regexp_replace(cut, r"\s+$", "")).otherwise(F.concat(F.regexp_replace(head, r"\s+$", ""), F.lit("...")))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _labelled(raw: Column, label: str) -> Column:
    found = F.regexp_extract_all(raw, F.lit(rf"(?ium)^\s*{label}\s*[:\-—][ \t]*(.*?)\s*$"), F.lit(1))
    return strip(F.try_element_at(found, F.lit(-1)))


def parse_model_output(raw: Column) -> Column:
    """struct<prefix, text, tickers> from a JSON object, or from labelled lines if it is none."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(_filled(raw)), r"(?i)^\s*```(?:json)?\s*\n?", ""), r"\n?\s*```\s*$", ""))
    is_object = F.try_parse_json(bare).isNotNull() & bare.startswith("{")
    read = F.from_json(F.when(is_object, bare), "prefix string, text string, tickers string")
    return F.struct(*[F.when(is_object, strip(read[k])).otherwise(_labelled(_filled(raw), v)).alias(k) for k, v in LABELS.items()])


def body_problem(text: Column) -> Column:
    """Why a text may not be published: empty, placeholder, too_few_words or repeated_token; null if it may."""
    t = strip(_filled(text))
    words = F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), F.lower)
    same = lambda w, i: (F.try_element_at(w, i) == F.try_element_at(w, i + 1)) & (F.try_element_at(w, i) == F.try_element_at(w, i + 2))
    # the words are bound once a row; named twice, they would be worked out for every place
    thrice = F.transform(F.array(words), lambda w: F.exists(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.coalesce(same(w, i), F.lit(False))))[0]
    return F.when(t == "", "empty").when(contains_any(F.lower(t), V.PLACEHOLDERS), "placeholder").when(F.size(words) < 3, "too_few_words").when(thrice, "repeated_token")


def has_residual_artifact(body: Column) -> Column:
    """A leaked placeholder, or a company spokesman without a quote after."""
    leaked = F.contains(body, F.lit("[сумма не указана]")) | F.contains(body, F.lit("нет цитаты"))
    return leaked | body.rlike(r"(?iuUs)представитель\s+компании(?!.*[«»„“”])")


def strip_invalid_years(body: Column, source: Column, year: Column) -> Column:
    """Drops sentences with a past year that the source does not name."""
    form = F.lit(YEAR)
    known = F.regexp_extract_all(source, form, F.lit(1))
    invented = lambda s: F.exists(F.regexp_extract_all(s, form, F.lit(1)), lambda y: (y.cast("int") < year) & ~F.array_contains(known, y))
    return strip(F.array_join(F.filter(sentences(body), lambda s: ~invented(s)), " "))


def plain_numbers(text: Column) -> Column:
    """Numbers of a text as doubles; blanks and commas between digits are read as they are meant."""
    joined = F.regexp_replace(text, r"(?<=[0-9])[\s ]+(?=[0-9])", "")
    joined = F.regexp_replace(joined, r"(?<=[0-9]),(?=[0-9]{3}(?:[^0-9]|$))", "")
    joined = F.regexp_replace(joined, r"([0-9]+),([0-9]{1,2})(?![0-9])", "$1.$2")
    return F.transform(F.regexp_extract_all(joined, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.try_cast("double"))


def ungrounded_numbers(body: Column, source: Column, within: float = 0.05) -> Column:
    """Numbers of a text that no number of the source comes within five per cent of."""
    known = plain_numbers(source)
    return F.filter(plain_numbers(body), lambda x: ~F.exists(known, lambda s: F.abs(x - s) / (s + 1e-9) <= within))
