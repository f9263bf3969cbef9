"""Scalar text functions as columns: normalising, similarity, numbers, markup, personal data, page classes."""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundaries, whatever letters stand around.
LEFT, RIGHT = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
REDACTED = "[REDACTED]"
#: The country's prefix, first digits of its mobile numbers, how many digits a number has and in what groups it is written, and words that announce one.
COUNTRY, MOBILE, DIGITS, GROUPS = "420", "67", 9, (3, 3, 3)
PHONE_WORDS = ["telefon", "tel", "phone", "mobil"]
#: JSON keys that hold a contact.
CONTACT_KEYS = "phone tel telefon mobile mobil email e-mail mail contact kontakt seller inzerent makler makléř broker agent jmeno jméno name advertiser".split()
ACCENTS = ("áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ", "acdeeinorstuuyzACDEEINORSTUUYZ")


def when_found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def address_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two address keys; 1 if both are empty, 0 if one is."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def normalised(text: Column) -> Column:
    """Lower case, each run of white space one space, trimmed; accents stay."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def phrase_hit(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text with no letter or digit on either side."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return (F.length(phrase) > 0) & F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{Nd}])"), quoted, F.lit(r"(?![\p{L}\p{Nd}])")))


def without_accents(text: Column) -> Column:
    return F.translate(text, *ACCENTS)


def czech_number(text: Column) -> Column:
    """"82,01" -> 82.01, "1.234,56" -> 1234.56, "1.234" -> 1234, "1.5" -> 1.5; null if it is no number."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    with_comma = F.regexp_replace(F.replace(plain, F.lit("."), F.lit("")), "^([^,]*),", "$1.")
    thousands = plain.rlike(r"^\d{1,3}(\.\d{3})+$")
    chosen = F.when(plain.contains(","), with_comma).when(thousands, F.replace(plain, F.lit("."), F.lit(""))).otherwise(plain)
    return F.when(chosen.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), chosen.try_cast("double"))


_REFERENCE = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][0-9A-Za-z]*);")


def _finished(text: str) -> str:
    """The text with those references decoded that a semicolon ends."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def unescaped(text: Column, unfinished: bool = True) -> Column:
    """Character references of HTML decoded, all names and numbers; as browsers do, old names also without a semicolon where unfinished says so."""
    decode = unescape if unfinished else _finished

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(decode, na_action="ignore")

    return run(text)


def html_text(html: Column, unfinished: bool = True) -> Column:
    """Text of a fragment: <br> is a line end, other tags go, character references are decoded (those without a semicolon where unfinished says so), white space is trimmed."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", "")
    out = F.when(out.contains("&"), unescaped(out, unfinished)).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(out, r"[ \u00a0\t\r\f]+", " "), r" ?\n ?", "\n")
    return F.btrim(out, F.lit(" \n"))


def html_title(html: Column) -> Column:
    return when_found(html, r"(?is)<title[^>]*>(.*?)</title>")


BLANKS = " \t\n\f\r"
_NUMBER = re.compile(rf"\+?[0-9](?:[{BLANKS}-]?[0-9])*")
_MAILBOX = frozenset("%+-._" + string.ascii_letters + string.digits)
_HOST = frozenset("-." + string.ascii_letters + string.digits)
_WORD = frozenset("_" + string.ascii_letters + string.digits)
_LONGEST_WORD = max(map(len, PHONE_WORDS))


def _mail_spans(text: str) -> list[tuple[int, int]]:
    """Mail addresses: what can stand in a mailbox before an at sign, and behind it a host whose last part has two letters or more."""
    spans, at, low = [], text.find("@"), 0
    while at >= 0:
        start, stop = at, at + 1
        while start > low and text[start - 1] in _MAILBOX:
            start -= 1
        while stop < len(text) and text[stop] in _HOST:
            stop += 1
        end, dot = 0, stop
        while not end and (dot := text.rfind(".", at + 2, dot)) >= 0:
            letters = dot + 1
            while letters < stop and text[letters].isalpha():
                letters += 1
            end = letters if letters > dot + 2 else 0
        if start < at and end:
            spans.append((start, end))
            low = end
        at = text.find("@", max(at + 1, end))
    return spans


def _phone_spans(text: str) -> list[tuple[int, int]]:
    """Phone numbers: digits in groups that single blanks or dashes part, judged by prefix, first digit, sizes of groups, and the word before."""
    spans = []
    for m in _NUMBER.finditer(text):
        runs = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer("[0-9]+", m[0])]
        places = [i for a, b in runs for i in range(a, b)]
        size = len(COUNTRY) + DIGITS
        if m[0].startswith("+" + COUNTRY) and len(places) >= size:
            spans.append((m.start(), places[size - 1] + 1))
            runs = [r for r in runs if r[0] > places[size - 1]]
        elif m[0][0] in MOBILE and runs[0][1] - runs[0][0] >= DIGITS:
            end = m.start()
            while end and text[end - 1] in BLANKS + ".:":
                end -= 1
            said = text[max(0, end - _LONGEST_WORD):end].lower()
            if word := next(filter(said.endswith, PHONE_WORDS), None):
                spans.append((end - len(word), m.start() + DIGITS))
        k = 0
        while k + len(GROUPS) <= len(runs):
            some = runs[k:k + len(GROUPS)]
            inside = text[some[0][0]] in MOBILE and tuple(b - a for a, b in some) == GROUPS
            apart = (some[0][0] == 0 or text[some[0][0] - 1] not in _WORD) and (some[-1][1] == len(text) or text[some[-1][1]] not in _WORD)
            if inside and apart:
                spans.append((some[0][0], some[-1][1]))
                k += len(GROUPS)
            else:
                k += 1
    return spans


def redacted(text: str) -> str:
    """The text without mail addresses and phone numbers."""
    for find in (_mail_spans, _phone_spans):
        parts, at = [], 0
        for start, stop in find(text):
            parts += [text[at:start], REDACTED]
            at = stop
        text = "".join(parts) + text[at:]
    return text


def redact(text: Column) -> Column:
    """Mail addresses and phone numbers of the country taken out: with its prefix, in groups of three, or after a word for phone; blanks of any kind or dashes may part the digits."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(redacted, na_action="ignore")

    return run(text)


def redact_json(body: Column) -> Column:
    """A JSON body without the values of contact keys at any depth, then redacted as text; a body that is no JSON as text."""
    @F.pandas_udf("string")
    def blank(bodies: pd.Series) -> pd.Series:
        def walk(v):
            if isinstance(v, dict):
                return {k: REDACTED if k.lower() in CONTACT_KEYS else walk(x) for k, x in v.items()}
            return [walk(x) for x in v] if isinstance(v, list) else v

        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(walk(json.loads(text)), ensure_ascii=False)
            except (ValueError, RecursionError):
                return text

        return bodies.map(one)

    return redact(F.when(F.btrim(body).rlike(r"^[{\[]"), blank(body)).otherwise(body))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


#: Words that give a page's class away.
CAPTCHA = ["g-recaptcha", "h-captcha", "hcaptcha", "recaptcha/api", "cf-turnstile", "data-sitekey", "captcha-widget"]
CHALLENGE = ["just a moment", "checking your browser", "attention required", "cf-browser-verification", "cf-challenge-running", "datadome", "_datadome", "enable javascript and cookies"]
CONSENT = ["cookiebot", "onetrust", 'id="didomi"', "consent-overlay"]
LOGIN = ["login", "přihlá", "prihlas"]
LISTING = ["inzerát", "inzerat", "nemovit", "prodej", "pronájem", "pronajem", "m²", "m2", "kč", "kc"]


def looks_listing(lowered: Column, words: list[str] = LISTING, least: int = 2) -> Column:
    return sum((lowered.contains(w).cast("int") for w in words), F.lit(0)) >= least


def protection(status: Column, server: Column, mitigated: Column, body: Column) -> Column:
    """captcha, challenge, login or null: what stands in place of the data asked for."""
    low = F.lower(body)
    listing = looks_listing(low)
    challenged = (F.coalesce(mitigated, F.lit("")) == "challenge") | (F.lower(F.coalesce(server, F.lit(""))).contains("ddos-guard") & (status == 403)) | contains_any(low, CHALLENGE) | ((status == 403) & low.contains("access denied"))
    return (F.when(contains_any(low, CAPTCHA) & ~listing, "captcha").when(challenged, "challenge")
            .when(low.contains('type="password"') & contains_any(low, LOGIN) & ~listing, "login").when(contains_any(low, CONSENT) & ~listing, "challenge"))


#: Default markers of who sells, with their confidences.
SELLER_RULES = {
    "private": (["přímý majitel", "prímý majitel", "jsem majitel", "jsem přímý", "realitní kanceláře nevolat", "bez realitky", "přímý prodej"], 0.90),
    "developer": (["stavební společnost", "developer"], 0.85),
    "agency": (["realitní kancelář", "realitni kancelar", "realitace", "s.r.o.", "s. r. o.", "a.s.", "společnost"], 0.85),
}


def seller_type(name: Column, description: Column, rules: dict[str, tuple[list[str], float]] = SELLER_RULES) -> Column:
    """private, developer (by name or text), agency (by name only) or null: the particular before the general."""
    n, d = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    marks = {k: [m.lower() for m in v[0]] for k, v in rules.items()}
    both = lambda k: contains_any(n, marks[k]) | contains_any(d, marks[k])
    return F.when(both("private"), "private").when(both("developer"), "developer").when(contains_any(n, marks["agency"]), "agency")


def seller_confidence(kind: Column, rules: dict[str, tuple[list[str], float]] = SELLER_RULES) -> Column:
    out = F.lit(None).cast("double")
    for k, (_, confidence) in rules.items():
        out = F.when(kind == k, confidence).otherwise(out)
    return out


def join_unique(parts: list[Column], separator: str = ", ") -> Column:
    """The parts that aren't null or empty, each once, in order."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != ""))
    return F.array_join(F.array_distinct(F.transform(kept, lambda p: F.trim(p))), separator)


def excerpt(text: Column, word: Column | str, before: int = 100, length: int = 300) -> Column:
    """Text around the first place of a word; null where it isn't."""
    at = F.instr(F.lower(text), word) if isinstance(word, str) else F.position(word, F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(length)))


def mine_guard(pattern: Column, quote: Column, text: Column) -> Column:
    """Null if a mined phrase may become a rule, else why not."""
    p, q, t = normalised(pattern), normalised(quote), normalised(text)
    return F.when(F.length(p) < 2, "too_short").when(p.rlike(r"\p{Nd}"), "has_digit").when(~q.contains(p), "not_in_quote").when(~t.contains(q), "not_in_text")


def first_of(*choices: Callable[[], Column] | Column) -> Column:
    return F.coalesce(*[c() if callable(c) else c for c in choices])
