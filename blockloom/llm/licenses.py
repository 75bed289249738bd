"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates.

Blocks and templates are sets of tokens. A block qualifies if it holds a template's tokens to the containment threshold, `need` of
them. Tokens have one global order, rarest first over all blocks that may qualify; a template's first size - need + 1 tokens
are its prefix, and a qualifying block holds one of them. The prefixes form an inverted index, which blocks are joined with by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, checkpoint, let, split_words, table
from .license_texts import TEMPLATES

#: Characters between words, after A-Z is lower-cased.
BREAK_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK_CHARS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Phrase and label (fixed values of the contract).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def word_array(text: Column) -> Column:
    return split_words(ascii_lower(F.coalesce(text, F.lit(""))), BREAK_RE, BREAK_CHARS)


def tokenised(templates, threshold: float) -> list[tuple[int, str, list[str], int]]:
    """(number, label, distinct tokens, need) of each template."""
    out = []
    for k, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()))
        out.append((k, label, tokens, -(-len(tokens) * round(threshold * 1000) // 1000)))
    return out


def first_sieve(index: list[tuple[int, str, list[str], int]]) -> tuple[list[str], list[str], int]:
    """(all tokens, prefix tokens by an order that needs no corpus: tokens of few templates first, least need)."""
    held: dict[str, int] = {}
    for _, _, tokens, _ in index:
        for t in tokens:
            held[t] = held.get(t, 0) + 1
    prefixes = {t for _, _, tokens, need in index for t in sorted(tokens, key=lambda t: (held[t], -len(t), t))[: len(tokens) - need + 1]}
    return sorted(held), sorted(prefixes), min((need for *_, need in index), default=0)


def blocks_of(text: Column) -> Column:
    """Lines, and paragraphs between blank lines where those hold several lines."""
    paragraphs = F.filter(F.split(text, r"\n[\x20\x09-\x0D]*\n", -1), lambda p: F.contains(p, F.lit("\n")))
    return F.concat(F.split(text, "\n", -1), paragraphs)


def similar_blocks(blocks: DataFrame, index: list[tuple[int, str, list[str], int]]) -> DataFrame:
    """row, label, containment of each pair of a block (row, block, tokens: distinct ones that templates hold) and a template that qualifies. A pair may come twice.

    Any total order of the tokens gives the same pairs; this one makes the lists of the index short. What is held together by key is
    bounded by the templates: a block's tokens are some of theirs.
    """
    spark = blocks.sparkSession
    held = [(k, label, t, len(tokens), need) for k, label, tokens, need in index for t in tokens]
    templates = spark.createDataFrame(held, "template int, label string, token string, size int, need int")
    frequency = blocks.select(F.explode("tokens").alias("token")).groupBy("token").count()
    order = Window.orderBy(F.coalesce("count", F.lit(0)), "token")
    ranks = checkpoint(templates.select("token").distinct().join(frequency, "token", "left").select("token", F.row_number().over(order).alias("rank")))
    ranked = templates.join(ranks, "token")
    whole = ranked.groupBy("template", "label", "size", "need").agg(F.sort_array(F.collect_list("rank")).alias("all"))
    prefix = whole.select("*", F.posexplode(F.slice("all", F.lit(1), F.col("size") - F.col("need") + 1)).alias("i", "rank"))
    tokens = blocks.select("row", "block", F.explode("tokens").alias("token")).join(ranks, "token")
    sets = tokens.groupBy("row", "block").agg(F.sort_array(F.collect_list("rank")).alias("own"))
    least = min(need for *_, need in index)
    # A block's own prefix: of a pair that qualifies, the first shared token has need - 1 others after it on either side.
    heads = sets.select("row", "own", F.size("own").alias("n"), F.posexplode(F.slice("own", F.lit(1), F.greatest(F.size("own") - (least - 1), F.lit(0)))).alias("j", "rank"))
    met = heads.join(prefix, "rank").filter((F.col("n") >= F.col("need")) & (F.col("n") - F.col("j") >= F.col("need")) & (F.col("size") - F.col("i") >= F.col("need")))
    overlap = F.size(F.array_intersect("own", "all"))
    return met.select("row", "label", "size", "need", overlap.alias("met")).filter("met >= need").select("row", "label", (F.col("met") / F.col("size").cast("double")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the largest containment found, 0 without any. Null texts are empty. Repeated rows and null ids each give a
    row; an empty table gives an empty one; other columns are not read. Texts of any length are read once, whole, in one pass that keeps of
    them only the phrase places and those blocks' tokens that templates hold. templates are (label, words) pairs.
    """
    index = tokenised(templates, threshold)
    vocabulary, prefixes, least = first_sieve(index)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def places(words: Column) -> Column:
        """(start, label) of each place where a phrase stands."""
        def at(i: Column) -> Column:
            out = F.lit(None).cast("string")
            for phrase, label in PHRASES.items():
                same = F.lit(True)
                for k, w in enumerate(phrase.split()):
                    same = same & F.coalesce(F.get(words, i + k) == w, F.lit(False))
                out = F.when(same, F.lit(label)).otherwise(out)
            return out

        heads = sorted({p.split()[0] for p in PHRASES})
        marked = F.transform(words, lambda w, i: F.when(w.isin(heads), F.struct(i.cast("long").alias("start"), at(i).alias("label"))))
        return F.filter(marked, lambda x: x["label"].isNotNull())

    def kept(words: Column) -> Column:
        """The sets of template tokens of blocks that hold a prefix token and enough tokens."""
        own = F.transform(blocks_of(text), lambda b: F.filter(F.array_distinct(word_array(b)), lambda w: w.isin(vocabulary)))
        near = F.filter(own, lambda b: (F.size(b) >= least) & F.exists(b, lambda w: w.isin(prefixes)))
        return F.when(F.exists(words, lambda w: w.isin(prefixes)), near).otherwise(F.array().cast("array<array<string>>"))

    x = let(word_array(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), places(w).alias("places"), (kept(w) if index else F.array().cast("array<array<string>>")).alias("blocks")))
    read = checkpoint(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), x.alias("x")).select("row", "doc_id", "x.*"))
    base = F.col("places.label")
    out = ["doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
           F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels")]
    if not index:
        return read.select(*out, F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("labels"), F.lit(0.0).alias("score"))
    blocks = read.filter(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "tokens"))
    found = similar_blocks(blocks, index).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    joined = read.drop("blocks").join(found, "row", "left")
    more = F.coalesce("found", F.array().cast("array<string>"))
    return joined.select(*out, F.array_join(F.sort_array(F.array_distinct(F.concat(base, more))), ",").alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"))


def op6_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def _sql_templates() -> str:
    return ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)


#: By comparing every block with every template.
OP6_SQL = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
w as (select k, doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from d),
hits as (
  select k, i - 1 as start, case when words[i] = 'cc' and words[i + 1] = 'by' then 'cc-by'
    when words[i] = 'general' and words[i + 1] = 'public' and words[i + 2] = 'license' then 'gpl'
    when words[i] = 'all' and words[i + 1] = 'rights' and words[i + 2] = 'reserved' then 'reserved' end as label
  from (select k, words, unnest(range(1, len(words) + 1)) as i from w)
), base as (select k, count(*) as n, min(start) as lo, max(start) as hi from hits where label is not null group by k),
t as (select label, list_distinct(string_split(words, ' ')) as tokens from (values {_sql_templates()}) v(label, words)),
b as (
  select distinct k, list_distinct(regexp_extract_all(translate(block, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as tokens
  from (select k, unnest(list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n'), lambda p: contains(p, chr(10))))) as block from d)
), near as (
  select k, label, len(list_intersect(b.tokens, t.tokens)) / len(t.tokens)::double as containment from b, t
  where len(list_intersect(b.tokens, t.tokens)) * 1000 >= len(t.tokens) * 800
), labels as (
  select k, string_agg(distinct label, ',' order by label) filter (from_base) as base_labels, string_agg(distinct label, ',' order by label) as labels, coalesce(max(containment), 0.0) as score
  from (select k, label, true as from_base, null::double as containment from hits where label is not null union all select k, label, false, containment from near) group by k
)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0) as n_base, lo as first_word, hi as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from w left join base using (k) left join labels using (k)
"""
