"""Russian Snowball stems, from the published algorithm, for tokens with Cyrillic letters; all other tokens stay."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The algorithm's endings. Group 1 endings need а or я before them.
_GERUND_1, _GERUND_2 = "в вши вшись", "ив ивши ившись ыв ывши ывшись"
_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
_PARTICIPLE_1, _PARTICIPLE_2 = "ем нн вш ющ щ", "ивш ывш ующ"
_REFLEXIVE = "ся сь"
_VERB_1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"
_VERB_2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
_SUPERLATIVE, _DERIVATIONAL = "ейш ейше", "ост ость"
_VOWELS = "аеиоуыэюя"


def _ending(free: str, after_a: str = "") -> re.Pattern:
    parts = sorted(free.split(), key=len, reverse=True)
    own = "|".join(parts)
    led = "|".join(sorted(after_a.split(), key=len, reverse=True))
    return re.compile(rf"(?:(?:{own})|(?<=[ая])(?:{led}))$" if led else rf"(?:{own})$")


_GERUND, _VERB = _ending(_GERUND_2, _GERUND_1), _ending(_VERB_2, _VERB_1)
_ADJ, _PART, _REFL, _NOUNS = _ending(_ADJECTIVE), _ending(_PARTICIPLE_2, _PARTICIPLE_1), _ending(_REFLEXIVE), _ending(_NOUN)
_SUPER, _DERIV = _ending(_SUPERLATIVE), _ending(_DERIVATIONAL)
_CYRILLIC = re.compile("[а-яё]")


def _strip(word: str, start: int, ending: re.Pattern) -> tuple[str, bool]:
    """Without an ending of the region from `start`; letters before it may only be looked at inside the region."""
    found = ending.search(word[start:])
    return (word[: start + found.start()], True) if found else (word, False)


def stem_ru(token: str) -> str:
    if not _CYRILLIC.search(token):
        return token
    word = token.replace("ё", "е")
    first = re.search(f"[{_VOWELS}]", word)
    if not first:
        return word
    rv = first.end()
    r1 = re.search(f"[{_VOWELS}][^{_VOWELS}]", word)
    r2_at = re.search(f"[{_VOWELS}][^{_VOWELS}]", word[r1.end() :]) if r1 else None
    r2 = r1.end() + r2_at.end() if r1 and r2_at else len(word)
    word, done = _strip(word, rv, _GERUND)
    if not done:
        word, _ = _strip(word, rv, _REFL)
        word, done = _strip(word, rv, _ADJ)
        if done:
            word, _ = _strip(word, rv, _PART)
        else:
            word, done = _strip(word, rv, _VERB)
            if not done:
                word, _ = _strip(word, rv, _NOUNS)
    if word[rv:].endswith("и"):
        word = word[:-1]
    if len(word) > r2:
        word, _ = _strip(word, r2, _DERIV)
    word, superlative = _strip(word, rv, _SUPER)
    if word[rv:].endswith("нн"):
        word = word[:-1]
    elif not superlative and word[rv:].endswith("ь"):
        word = word[:-1]
    return word


def stemmed(tokens: Column) -> Column:
    """An array of tokens with Russian stems, by an Arrow function; only arrays with Cyrillic are worth the trip."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        held: dict[str, str] = {}
        return batch.map(lambda ts: None if ts is None else [held.get(t) or held.setdefault(t, stem_ru(t)) for t in ts])

    return F.when(F.exists(tokens, lambda t: t.rlike("[а-яё]")), run(tokens)).otherwise(tokens)
