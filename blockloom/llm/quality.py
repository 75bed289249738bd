"""Quality rules, line first: bad lines go, then documents that lost too much.

Built from DataFrame functions only; one pass over the text without a shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, split_words, table

WORD_RE = r"[^\x20\x09-\x0D]"
#: Characters counted by the contract as symbols.
SYMBOL_RE = r"[#*$%&|<>]"
#: Marks that flowing prose holds few of; a line rich in them fails the punctuation rule.
MARK_RE = r"[#*$%&|<>!?~^=_{}\\@+/»›]"
#: Entries of a site's navigation, in English, German, French and Spanish (fixed list).
ENTRIES = (
    "home", "menu", "log ?in", "log ?out", "sign ?in", "sign ?up", "register", "search", "next", "previous", "prev", "back to top", "read more",
    "skip to content", "share", "tweet", "contact us", "contact", "about us", "about", "us", "site ?map", "help", "faq",
    "startseite", "menü", "anmelden", "abmelden", "registrieren", "suche", "weiter", "zurück", "nach oben", "mehr lesen", "zum inhalt springen",
    "teilen", "kontakt", "über uns", "hilfe", "impressum", "datenschutz",
    "accueil", "connexion", "déconnexion", "inscription", "rechercher", "suivant", "précédent", "haut de page", "lire la suite", "aller au contenu",
    "partager", "à propos", "plan du site", "aide", "mentions légales",
    "inicio", "menú", "iniciar sesión", "cerrar sesión", "registrarse", "buscar", "siguiente", "anterior", "volver arriba", "leer más",
    "saltar al contenido", "compartir", "contacto", "quiénes somos", "mapa del sitio", "ayuda", "aviso legal",
)
#: Whole lines of such entries; a lone "us" or "about" is none.
NAVIGATION = r"(?i)^\W*(" + "|".join(e for e in ENTRIES if e not in ("us", "about", "contact")) + r")(\W+(" + "|".join(ENTRIES) + r"))*\W*$"
#: Sentences, in lower case, that sites repeat on each page, in the same languages (fixed list).
BOILERPLATE = (
    "cookie policy", "use cookies", "uses cookies", "accept cookies", "accept all cookies", "privacy policy", "terms of use",
    "terms of service", "enable javascript", "javascript is disabled", "javascript is required",
    "subscribe to our newsletter", "click here to", "all content on this site", "all content on this page", "lorem ipsum",
    "cookie-richtlinie", "verwendet cookies", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "javascript aktivieren", "newsletter abonnieren", "klicken sie hier",
    "utilise des cookies", "accepter les cookies", "politique de confidentialité", "conditions d'utilisation", "activer javascript", "abonnez-vous à notre newsletter", "cliquez ici",
    "utiliza cookies", "aceptar cookies", "política de cookies", "política de privacidad", "términos de uso", "activar javascript", "suscríbete a nuestro boletín", "haga clic aquí",
)


def _has_boilerplate(text: Column) -> Column:
    return let(F.lower(text), lambda t: reduce(or_, (F.contains(t, F.lit(p)) for p in BOILERPLATE)))


def line_fails(line: Column, suspect: Column, max_marks: float = 0.1, max_boilerplate_words: int = 40) -> Column:
    """Whether a line breaks the punctuation, navigation or boilerplate rule. suspect: false if the whole text holds no boilerplate."""

    def ruled(marks: Column) -> Column:
        bars = (marks >= 3) & (F.regexp_count(line, F.lit("[|»›]")) >= 3)
        punctuation = (F.length(line) >= 8) & (marks > F.length(line) * max_marks)
        navigation = (F.length(line) <= 100) & line.rlike(NAVIGATION)
        boilerplate = suspect & (F.size(F.split(line, " ")) <= max_boilerplate_words) & _has_boilerplate(line)
        return punctuation | bars | navigation | boilerplate

    return let(F.regexp_count(line, F.lit(MARK_RE)), ruled)


def repeated_window_words(words: Column, width: int = 8) -> Column:
    """Words that lie in a window of `width` words found twice or more in the text."""

    def covered(marked: Column) -> Column:
        places = F.sort_array(F.filter(marked, lambda p: p.isNotNull()))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1), x + width) - x)),
            F.lit(0), lambda a, b: a + b))

    def marks(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))

    def of_windows(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda s: covered(marks(s))))

    def doubled(h: Column, step: int) -> Column:
        """Hashes of 2 * step words from those of step words; the tail, where no such window fits, is cut at the end."""
        if step == width:
            return let(F.slice(h, F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(0))), of_windows)
        return let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))), lambda g: doubled(g, 2 * step))

    # width is a power of two: one word, then 2, 4, ... by pairs.
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1)))


def quality_columns(text: Column, max_lost: float = 0.5) -> Column:
    """A struct of the counts, the verdict and the cleaned text."""
    text = F.coalesce(text, F.lit(""))
    letters = lambda words: F.length(F.array_join(words, ""))

    def judged(w: Column, lines: Column, suspect: Column) -> Column:
        good = F.filter(lines, lambda l: ~line_fails(l, suspect))
        spoken = F.filter(lines, lambda l: l.rlike(WORD_RE))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            letters(w).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL_RE)).cast("long").alias("n_symbols"),
            let(spoken, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_window_words(w).cast("long").alias("n_repeat_words"),
            let(good, lambda g: F.struct((F.size(g) == F.size(lines)).alias("whole"), F.array_join(g, "\n").alias("text"))).alias("clean"),
        )

    def verdict(x: Column) -> Column:
        base = (x["n_words"] < 20) | (x["n_repeat_words"] * 100 > x["n_words"] * 30)
        lost = F.when(x["clean"]["whole"], F.lit(0)).otherwise(x["word_chars"] - letters(split_words(x["clean"]["text"])))
        return F.struct(
            *(x[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            base.alias("base_failed"),
            (~base & (lost <= x["word_chars"] * max_lost)).alias("kept"),
            lost.cast("long").alias("lost_chars"),
            x["clean"]["text"].alias("clean_text"),
        )

    parts = F.struct(split_words(text).alias("w"), F.split(text, "\n", -1).alias("lines"), _has_boilerplate(text).alias("suspect"))
    return let(let(parts, lambda p: judged(p["w"], p["lines"], p["suspect"])), verdict)


def quality(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """doc_id, the contract's counts, base_failed, kept, lost_chars and clean_text (the lines that pass).

    A null text counts as empty, so it has no words and fails. Rows are judged one by one: repeated rows and
    null ids each give a row. An empty table gives an empty one; other columns of the input are not read. Texts are judged whole, whatever their length.
    """
    return docs.select(F.col("doc_id").cast("long"), quality_columns(F.col("text"), max_lost).alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """The documents that pass, with their cleaned text; all columns of the input, n_chars brought up to date."""
    # explode() of the verdicts that keep: a filter on the struct would be pushed below and compute it twice.
    passed = F.filter(F.array(quality_columns(F.col("text"), max_lost)), lambda q: q["kept"])
    whole = docs.select(F.struct("*").alias("row"), F.explode(passed).alias("q"))
    new = {"text": F.col("q.clean_text"), "n_chars": F.length("q.clean_text").cast("long")}
    return whole.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def op7_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents")).drop("clean_text")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: Line by line, and window by window.
OP7_SQL = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
w as (select k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
windows as (select k, i, array_to_string(words[i : i + 7], ' ') as win from (select k, words, unnest(range(1, len(words) - 6)) as i from w)),
twice as (select k, i from windows join (select k, win from windows group by all having count(*) > 1) using (k, win)),
covered as (select k, sum(least(8, coalesce(following - i, 8))) as n from (select k, i, lead(i) over (partition by k order by i) as following from twice) group by k),
l as (
  select k, line, length(line) as n, len(regexp_extract_all(line, {_sql_text(MARK_RE)})) as marks, len(regexp_extract_all(line, '[|»›]')) as bars,
    regexp_extract_all(line, '[^\x20\x09-\x0D]+') as words, len(string_split(line, ' ')) as spaced, lower(line) as low
  from (select k, unnest(string_split(text, chr(10))) as line from d)
), judged as (
  select k, line, words, (n >= 8 and marks > n * 0.1::double) or (marks >= 3 and bars >= 3) or (n <= 100 and regexp_matches(line, {_sql_text(NAVIGATION)}))
    or (spaced <= 40 and ({" or ".join(f"contains(low, {_sql_text(p)})" for p in BOILERPLATE)})) as bad
  from l
), lines as (
  select k, count(*) filter (len(words) > 0) - count(distinct line) filter (len(words) > 0) as n_dup_lines,
    coalesce(sum(list_sum(list_transform(words, lambda x: length(x)))) filter (bad), 0) as lost_chars
  from judged group by k
), counted as (
  select k, doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars,
    len(regexp_extract_all(text, '{SYMBOL_RE}')) as n_symbols, coalesce(n, 0) as n_repeat_words, n_dup_lines, lost_chars
  from w left join covered using (k) join lines using (k)
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and lost_chars <= word_chars * 0.5::double as kept, lost_chars::bigint as lost_chars
from counted
"""
