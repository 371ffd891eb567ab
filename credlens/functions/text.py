"""Column expressions for post text: JVM-side built-ins, and the removals of the
cleaning rule as Arrow kernels over a batch of texts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def extract_text(record: Column | str = "record") -> Column:
    """Post text, else the quoted post's text, else ''.  Null-safe on every
    level of the nested record."""
    r = F.col(record) if isinstance(record, str) else record
    own = r.getField("text")
    quoted = r.getField("embed").getField("record").getField("record").getField("text")
    return F.coalesce(F.nullif(own, F.lit("")), quoted, F.lit(""))


_FROM, _TO = "".join(fixed.ONE_LETTER), "".join(fixed.ONE_LETTER.values())


def spell_letters(c: Column) -> Column:
    """Hebrew, Arabic, Devanagari and kana letters by table, Hangul syllables
    by the places of their parts; every other character as it is."""
    table = F.create_map(*[F.lit(x) for pair in fixed.BY_LETTER.items() for x in pair])
    vowels, finals = len(fixed.HANGUL_VOWELS), len(fixed.HANGUL_FINALS)

    def part(names: tuple[str, ...], at: Column) -> Column:
        return F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))

    def spelled(ch: Column) -> Column:
        n = F.ascii(ch) - fixed.HANGUL_FIRST   # ascii: the code point of the first character
        syllable = F.concat(part(fixed.HANGUL_INITIALS, F.floor(n / (vowels * finals))),
                            part(fixed.HANGUL_VOWELS, F.floor(n / finals) % vowels), part(fixed.HANGUL_FINALS, n % finals))
        hangul = ch.between(chr(fixed.HANGUL_FIRST), chr(fixed.HANGUL_LAST))
        return F.when(hangul, syllable).otherwise(F.coalesce(F.element_at(table, ch), ch))
    return F.array_join(F.transform(F.split(c, ""), spelled), "")


def strip_accents(c: Column) -> Column:
    """Letters with diacritics, small digits, fractions and other scripts to
    ASCII: one translate, then the letters spelled with several; those of
    other scripts only where such a letter is there (one test for all)."""
    t = F.translate(c, _FROM, _TO)
    for letter, ascii_ in fixed.SEVERAL_LETTERS.items():
        if letter in fixed.SPECIAL_LETTERS:
            t = F.replace(t, F.lit(letter), F.lit(ascii_))
    other = t
    for letter, ascii_ in fixed.SEVERAL_LETTERS.items():
        if letter not in fixed.SPECIAL_LETTERS:
            other = F.replace(other, F.lit(letter), F.lit(ascii_))
    spelled = F.when(other.rlike(fixed.LETTER_SCRIPTS_PATTERN), spell_letters(other)).otherwise(other)
    return F.when(t.rlike(fixed.ANY_SCRIPT_PATTERN), spelled).otherwise(t)


def _finish(t: Column) -> Column:
    t = F.regexp_replace(t, fixed.NON_WORD_PATTERN, "")
    t = strip_accents(t)
    return F.trim(F.regexp_replace(t, fixed.SPACES_PATTERN, " "))


#: Outside Latin letters and general punctuation the engines' letter classes may differ by Unicode version.
NOT_LATIN = r"[^\x00-\x{24f}\x{2000}-\x{206f}]"
# after the removals a character that is neither a word's nor a blank is other white space
_RUNS_PATTERN = rf"[{fixed.SPACE}]{{2,}}|[^\p{{L}}\p{{N}}_\x20]"


def _removals() -> Callable[[pa.Array], pa.Array]:
    """Lower-case texts without URLs, mentions, hashtags and non-word characters,
    white space collapsed; NULL for texts that hold other than Latin characters.
    The function carries its patterns, so tasks need no module of this library."""
    other, non_word, runs = NOT_LATIN, fixed.NON_WORD_PATTERN + "+", _RUNS_PATTERN
    wholes = (fixed.URL_PATTERN, fixed.MENTION_PATTERN, fixed.HASHTAG_PATTERN)

    def run(low: pa.Array) -> pa.Array:
        t = pc.if_else(pc.match_substring_regex(low, other), pa.scalar(None, low.type), low)
        special = pc.or_(pc.match_substring(t, "http"), pc.or_(pc.match_substring(t, "@"), pc.match_substring(t, "#")))
        special = pc.fill_null(special, False)
        if pc.any(special).as_py():
            some = t.filter(special)
            for pattern in wholes:
                some = pc.replace_substring_regex(some, pattern, "")
            t = pc.replace_with_mask(t, special, some)
        return pc.replace_substring_regex(pc.replace_substring_regex(t, non_word, ""), runs, " ")
    return run


def clean_text(c: Column | str) -> Column:
    """lower -> drop URLs, mentions, hashtags -> drop non-word characters ->
    accents to ASCII -> collapse white space -> trim.

    The removals run over batches of texts; ASCII texts are then done, and
    accents are looked for in the others only.  No Latin letter is spelled with
    a space or with nothing, so white space stays collapsed.  Texts with other
    scripts take the same steps one by one."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    t = F.arrow_udf(_removals(), "string")(low)
    latin = F.trim(F.when(F.octet_length(t) == F.char_length(t), t).otherwise(strip_accents(t)))
    other = F.regexp_replace(low, fixed.URL_PATTERN, "")
    other = F.regexp_replace(other, fixed.MENTION_PATTERN, "")
    other = F.regexp_replace(other, fixed.HASHTAG_PATTERN, "")
    return F.when(t.isNotNull(), latin).otherwise(_finish(other))


def words(c: Column | str) -> Column:
    """Words of a cleaned text (single-space separated); [] for ''."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(col, " "))


def suffix_lemma(lang2: Column, w: Column) -> Column:
    """The word with its longest listed ending replaced (``lang2`` en or fr)."""
    def by_rules(lang: str) -> Column:
        out = F.when(F.lit(False), w)
        for ending, instead in fixed.lemma_suffixes(lang):
            left = F.length(w) - len(ending)
            out = out.when(w.endswith(ending) & (left + len(instead) >= fixed.LEMMA_LETTERS),
                           F.concat(F.substring(w, F.lit(1), left), F.lit(instead)))
        return out.otherwise(w)
    return F.when(lang2 == "fr", by_rules("fr")).otherwise(by_rules("en"))


def vectorizer_words(c: Column | str) -> Column:
    """Words of two or more word characters (the vectorizer's tokens)."""
    return F.filter(words(c), lambda w: F.length(w) >= 2)


def first_lang(langs: Column | str = "langs") -> Column:
    """First declared language, NULL when there is none."""
    l = F.col(langs) if isinstance(langs, str) else langs
    return F.when(F.size(l) > 0, F.get(l, 0))
