"""Quality rules, line first, with DataFrame functions alone: all in one pass and without a shuffle.

Each line is judged: its punctuation (odd marks, a cut-off end, capitals alone), whether it is navigation (separators, links, a date
alone, one of several short lines without an end mark), whether it is boilerplate (a phrase of four languages, between word borders). Lines
that fail are removed. A text that loses too large a share of its words is rejected, and so is one that is too short or that repeats itself
(the base rules, judged on the whole input text).

A null text counts as one without words and is rejected as too short. Empty lines pass, and end a run of short ones. Repeated rows give
repeated results, equal lines of a text equal verdicts but where runs differ. A text of any length is one row's work. An empty table gives no
rows. `judge` keeps all columns of its input: it returns them as one struct `row` beside its own
results, so that no names can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_WORD, settled, space_words

# The symbols that the base rules count, and phrases of boilerplate lines.
SYMBOLS = r"[#*$%&|<>]"
BOILERPLATE = [
    "accept all cookies", "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "forgot your password", "log in", "privacy policy", "read more", "share this",
    "sign up", "skip to content", "subscribe to our", "terms of service", "terms of use",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "mehr erfahren", "nach oben", "newsletter abonnieren", "nutzungsbedingungen", "passwort vergessen", "zum inhalt springen",
    "accepter les cookies", "aller au contenu", "cliquez ici", "conditions d'utilisation", "en savoir plus", "haut de page", "mentions légales", "mot de passe oublié", "politique de confidentialité", "tous droits réservés",
    "aceptar cookies", "aviso legal", "condiciones de uso", "haga clic aquí", "iniciar sesión", "ir al contenido", "leer más", "política de privacidad", "todos los derechos reservados", "volver arriba",
]
#: Doubled marks, and symbols that prose seldom has.
ODD_MARKS = r"[!?]{2,}|[#*$%&<>^~]+"
SEPARATORS = "|»›·"
LINKS = r"https?://|www[.]"
#: What ends a sentence, a quotation or the part of one that leads on.
END_MARK = r"[.!?:;,…\"'»”’)\]]\z"
CUT_OFF = r"([.][.][.]|…)\z"
DATE_LINE = (
    r"^[^a-z0-9]*((posted|published|updated|modified|veröffentlicht|aktualisiert|publié|publicado|actualizado|on|at|am|um|le|el)[^a-z0-9]+)*"
    r"([0-9]{1,2}:[0-9]{2}|[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4})[^a-z]*\z"
)
PHRASE = f"(^|[^a-z0-9])({'|'.join(BOILERPLATE)})([^a-z0-9]|\\z)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a short line at most, and how many of them make a run; words of a date's line at most; capitals of a line of capitals at least.
SHORT, RUN, DATE_WORDS, CAPITALS = 4, 3, 8, 10


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def _sorted_windows(words: Column, n: Column) -> Column:
    """The 3-word windows with their places, sorted by hash: windows with equal words are neighbours."""
    return F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))))


def _repeated_places(keyed: Column) -> Column:
    """Where windows start that are found twice or more, ascending."""
    same = lambda x, i, d: F.coalesce(F.get(keyed, i + d)["h"] == x["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(keyed, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))


def _without(line: Column, characters: str) -> Column:
    return F.length(line) - F.length(F.translate(line, characters, ""))


def line_facts(text: Column) -> Column:
    """Per line: the line, its words, odd marks, separators and capitals, whether it is short and has no end mark, and whether it is cut off."""

    def facts(line: Column) -> Column:
        n = F.regexp_count(line, F.lit(SPACE_WORD))
        capitals = F.when(_without(line, LOWER) == 0, _without(line, UPPER)).otherwise(0)
        cut_off = (F.right(line, F.lit(1)).isin(".", "…")) & line.rlike(CUT_OFF)
        return F.struct(line.alias("line"), n.alias("n"), F.regexp_count(line, F.lit(ODD_MARKS)).alias("odd"), _without(line, SEPARATORS).alias("bars"), capitals.alias("capitals"), cut_off.alias("cut_off"))

    return F.transform(F.split(text, "\n"), facts)


def line_verdicts(facts: Column, odd_share: float, bar_share: float, boilerplate_words: int) -> Column:
    """Per line: the line, its number of words, and whether its punctuation fails it, it is navigation, or boilerplate. Costly patterns are tried
    on lines alone that are short enough for them."""
    item = lambda x: x.isNotNull() & (x["n"] > 0) & (x["n"] <= SHORT) & ~x["line"].rlike(END_MARK)

    def in_run(x: Column, i: Column) -> Column:
        near = {k: F.coalesce(item(F.when(i + k >= 0, F.get(facts, i + k))), F.lit(False)) for k in range(1 - RUN, RUN) if k}
        every = F.lit(False)
        for first in range(1 - RUN, 1):
            some = F.lit(True)
            for k in range(first, first + RUN):
                some = some & near[k] if k else some
            every = every | some
        return item(x) & every

    def judged(x: Column, i: Column) -> Column:
        line, n = x["line"], x["n"]
        lower = F.translate(line, UPPER, LOWER)
        punctuation = (x["odd"] > odd_share * n) | x["cut_off"] | (x["capitals"] >= CAPITALS)
        links = F.when(F.contains(line, F.lit("www.")) | F.contains(line, F.lit("://")), 2 * F.regexp_count(line, F.lit(LINKS)) >= n).otherwise(False)
        date = F.when((n > 0) & (n <= DATE_WORDS), lower.rlike(DATE_LINE)).otherwise(False)
        navigation = (x["bars"] > bar_share * n) | links | date | F.when((n > 0) & (n <= SHORT), in_run(x, i)).otherwise(False)
        phrase = F.when((n > 0) & (n <= boilerplate_words), lower.rlike(PHRASE)).otherwise(False)
        return F.struct(line.alias("line"), n.alias("n"), punctuation.alias("punctuation"), navigation.alias("navigation"), phrase.alias("boilerplate"))

    return F.transform(facts, judged)


def judge(
    docs: DataFrame, text_col: str = "text", least_words: int = 50, most_repeated: int = 50, most_lost: int = 50, odd_share: float = 0.25, bar_share: float = 0.25, boilerplate_words: int = 20
) -> DataFrame:
    """Struct `row` of the input's columns, the base counts, base_failed, kept, n_lines_removed, n_words_lost, clean_text.

    most_repeated, most_lost: per cent of the words."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(text_col, F.lit("")).alias("t"))
    base = base.select("row", "t", space_words(F.col("t")).alias("words"), line_facts(F.col("t")).alias("facts"))
    base = base.select("row", "t", "words", line_verdicts(F.col("facts"), odd_share, bar_share, boilerplate_words).alias("lines"))
    base = base.select("row", "t", "lines", "words", F.size("words").alias("n"), _sorted_windows(F.col("words"), F.size("words")).alias("keyed"))
    base = base.select("row", "t", "lines", "n", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), _repeated_places(F.col("keyed")).alias("at"))
    bad = lambda x: x["punctuation"] | x["navigation"] | x["boilerplate"]
    worded = F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: x["line"])
    good = F.filter("lines", lambda x: ~bad(x))
    base = base.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
        F.coalesce(_sum(F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3))))), F.lit(0).cast("long")).alias("n_repeat_words"),
        (F.size("lines") - F.size(good)).cast("long").alias("n_lines_removed"),
        _sum(F.transform(F.filter("lines", bad), lambda x: x["n"])).alias("n_words_lost"),
        F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("clean_text"),
    )
    base = settled(base)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return base.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_words_lost") <= most_lost * F.col("n_words")))


def keep_clean(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **rules) -> DataFrame:
    """The input's columns of the texts that are kept, without their failed lines; chars_col is counted anew where it is a column."""
    kept = judge(docs, text_col, **rules).filter("kept")
    changed = F.col("n_lines_removed") > 0
    cells = {c: F.col("row")[c] for c in docs.columns}
    cells[text_col] = F.when(changed, F.col("clean_text")).otherwise(cells[text_col])
    if chars_col in cells:
        cells[chars_col] = F.when(changed, F.length("clean_text").cast(docs.schema[chars_col].dataType)).otherwise(cells[chars_col])
    return kept.select(*[x.alias(c) for c, x in cells.items()])
