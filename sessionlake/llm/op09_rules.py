"""Line-first quality rules, in DataFrame functions only.

Each line is judged by itself: stubs without end punctuation, lines without a letter or digit, lines of symbols or
exclamation marks, navigation bars and boilerplate. Failed lines are removed; a document that loses more than
`max_lost_percent` of its word characters is rejected, as is one that is short or repeats itself (base rules).

Defined results: a null or empty text has no words, so it fails the base rules and is not kept; a text of one line is
judged as that line. One row for each input row, repeated rows included; an empty table gives an empty result; texts of
any length are read whole. `clean` keeps all columns of docs, whatever their names; `assess` adds its own. There is no
shuffle: every rule reads one row, at a cost of n log n in its words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SPACES = SPACE + "+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
ENDS = r"[.!?:;…。！？]['\"»”’)\]]*[\x20\x09-\x0D]*$"
#: Stock phrases of page furniture and licence notes by language, in lower case.
BOILERPLATE = {
    "en": [
        "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "accept all cookies", "enable javascript", "subscribe to our",
        "sign up now", "sign up today", "sign up for", "click here", "read more", "share this", "share on", "powered by", "skip to content", "skip to main content", "copyright ©", "© 19", "© 20",
    ],
    "de": ["alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "newsletter abonnieren", "hier klicken", "weiterlesen", "zum inhalt springen"],
    "fr": ["tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "accepter les cookies", "accepter tous les cookies", "abonnez-vous", "cliquez ici", "lire la suite", "aller au contenu"],
    "es": ["todos los derechos reservados", "términos de uso", "términos del servicio", "política de privacidad", "aceptar cookies", "aceptar todas las cookies", "suscríbete a", "haz clic aquí", "leer más", "saltar al contenido"],
}
BOILERPLATE_WORDS = 30
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 40


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable is bound, while a plain column may be inlined again."""
    return F.transform(F.array(value), body)[0]


def count_chars(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def stock_phrase(low: Column) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(p) for phrases in BOILERPLATE.values() for p in phrases])


def line_fails(line: Column) -> Column:
    """True for a line with words that fails a rule; blank lines carry no words and stay."""

    def judged(n: Column) -> Column:
        n_sep, n_sym, n_loud = count_chars(line, SEPARATORS), count_chars(line, SYMBOLS), count_chars(line, "!")
        return (n > 0) & (
            ((n < 4) & ~line.rlike(ENDS))
            | ~line.rlike(r"[\p{L}\p{N}]")
            | ((n_sep >= 3) & (n_sep * 4 >= n))
            | ((n_sym >= 6) & (n_sym > n))
            | ((n_loud >= 6) & (n_loud * 2 > n))
            | ((n <= BOILERPLATE_WORDS) & let(F.lower(line), stock_phrase))
        )

    return let(F.regexp_count(line, F.lit(WORD)), judged)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more: equal windows meet by sorting (hash, place)."""

    def tail(x: Column, k: int) -> Column:
        return F.slice(x, F.lit(k + 1), F.greatest(F.size(x) - k, F.lit(0)))

    def hashed(h: Column) -> Column:
        pairs = F.zip_with(tail(h, 0), tail(h, 1), lambda a, b: F.xxhash64(a, b))
        triples = F.zip_with(pairs, tail(h, 2), lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab, c)))
        return F.slice(triples, F.lit(1), F.size(h) - 2)

    def keyed(t: Column) -> Column:
        return F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def count(t: Column) -> Column:
        """Only a text with a repeat is sorted."""
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(let(let(keyed(t), places), covered))

    def covered(s: Column) -> Column:
        gaps = F.zip_with(s, tail(s, 1), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda n, g: n + g)

    def places(k: Column) -> Column:
        """Where neighbours in the sorted order agree, both places; each place once, in order."""
        same = F.zip_with(k, tail(k, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(let(hashes, hashed), count)).cast("long")


def words_of(text: Column) -> Column:
    """The words of a text, without an empty first or last one."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def judged(text: Column, max_lost_percent: int) -> Column:
    """All counts and verdicts of a text, and the text without its failed lines, as one struct."""
    text = F.coalesce(text, F.lit(""))
    glyphs = lambda x: F.char_length(x) - F.regexp_count(x, F.lit(SPACE))

    def by_line(rows: Column) -> Column:
        failed = F.filter(rows, lambda x: x["bad"])
        good = F.transform(F.filter(rows, lambda x: ~x["bad"]), lambda x: x["line"])
        lost = F.aggregate(failed, F.lit(0), lambda n, x: n + glyphs(x["line"]))
        return F.struct(F.size(failed).cast("long").alias("n_failed"), lost.cast("long").alias("lost"), F.array_join(good, "\n").alias("clean"))

    def counted(text: Column) -> Column:
        lines = F.split(text, "\n")
        full = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
        return F.struct(
            let(F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x).alias("bad"))), by_line).alias("lines"),
            let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"))).alias("words"),
            glyphs(text).cast("long").alias("word_chars"),
            count_chars(text, SYMBOLS).cast("long").alias("n_symbols"),
            let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    def verdicts(c: Column) -> Column:
        n, repeated, lost = c["words"]["n"], c["words"]["repeated"], c["lines"]["lost"]
        base = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
        kept = ~base & (100 * lost <= max_lost_percent * c["word_chars"])
        named = {
            "n_words": n, "word_chars": c["word_chars"], "n_symbols": c["n_symbols"], "n_dup_lines": c["n_dup_lines"], "n_repeat_words": repeated, "n_failed_lines": c["lines"]["n_failed"],
            "lost_chars": lost, "base_failed": base, "kept": kept, "clean_text": c["lines"]["clean"],
        }
        return F.struct(*[v.alias(k) for k, v in named.items()])

    return let(let(text, counted), verdicts)


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars", "base_failed", "kept", "clean_text"]


def free_name(docs: DataFrame, name: str = "_judged") -> str:
    """A column name that docs has not, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def assess(docs: DataFrame, text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, lost_chars, base_failed,
    kept and clean_text (the text without failed lines). Columns of docs with these names are replaced."""
    own = [c for c in docs.columns if c.lower() not in FIELDS]
    # a generator computes its row once, where a projected struct may be computed for each field that is read
    return docs.select(*own, F.inline(F.array(judged(F.col(text_col).cast("string"), max_lost_percent))))


def clean(docs: DataFrame, text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The kept documents with failed lines removed, in the columns of docs."""
    name = free_name(docs)
    kept = F.filter(F.array(judged(F.col(text_col).cast("string"), max_lost_percent)), lambda j: j["kept"])
    rows = docs.select("*", F.explode(kept).alias(name))
    return rows.select(*[F.col(name)["clean_text"].alias(c) if c == text_col else F.col(c) for c in docs.columns])
