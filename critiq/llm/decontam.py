"""Benchmark decontamination by template canonicalisation, in SQL functions only.

A text's tokens are runs of letters or of digits (with inner . , : /). In a template numbers become <num>, behind a
sign of arithmetic with that sign, a unit behind a number <unit>, a capitalised word <name>, and all else is lower case. A capitalised word that
opens a sentence may be a name or not, so there are two templates: one has it as a name, one as a word.

Items of the same template whose slots repeat in the same places are one class. Windows of WINDOW tokens of the texts, in both templates and
as lower-cased raw tokens, meet the classes' windows by one hash join. A class is held where enough of its template's windows are
met; on each diagonal (place in the text less place in the item) the slot values must map one to one between item and text, so
other numbers or names are caught while a text that mixes its slots up is not: windows that hold such a slot do not count. Where a
class is not held, its finer members are tried: the template with opening words as words, and the raw tokens of
every different text, which find copies in other case, items that are nearly all slots, and short ones.

Template windows without a literal token say nothing and do not count, and a template needs two literal tokens in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from critiq.llm.shared import saved

WINDOW = 8
#: Literal tokens (words, and numbers behind a sign of arithmetic) that a template must have.
LEAST_LITERALS = 2
UNITS = ("km", "m", "cm", "mm", "mile", "miles", "ft", "feet", "inch", "inches", "kg", "g", "mg", "lb", "lbs", "pounds", "oz", "l", "ml", "liters",
         "litres", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "usd", "eur", "dollars", "euros",
         "cents", "percent", "degrees", "mph", "kmh", "kw", "w", "v", "hz", "gb", "mb")
SIGN = r"^\\s*([-+*/×÷=^])\\s*$"
#: Up to this many bytes of keys are broadcast; more go through a shuffled join.
BROADCAST_BYTES = 32 << 20
TOKEN = r"([^\\p{L}\\p{N}]*)(\\p{N}+(?:[.,:/]\\p{N}+)*|\\p{L}[\\p{L}\\p{M}]*)"
IS_SLOT, IS_LITERAL = "{} LIKE '%>'", "{} NOT LIKE '<%'"  # a number behind a sign is both


def _tokens(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, low, name, word): lower-cased raw tokens, and the tokens of the templates with opening words as names and as words."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    # the lambda sees nothing but its element: a column named in it would be evaluated anew for each element
    # a token begins with a letter or a digit, and ASCII digits stand before all letters: most tokens need no pattern
    number = "({0} < ':' OR {0} > '\\u007F' AND {0} RLIKE '^\\\\p{{N}}')"
    signed = f"concat(regexp_extract(p.gap, '{SIGN}', 1), '<num>')"
    forms = f"""transform(parts, (p, i) -> CASE
        WHEN {number.format('p.token')} THEN named_struct('name', {signed}, 'word', {signed})
        WHEN p.low != p.token THEN named_struct('name', '<name>', 'word', IF(i > 0 AND NOT p.gap RLIKE '[.!?:\\n]', '<name>', p.low))
        WHEN p.before != '' AND {number.format('p.before')} AND p.low IN ({units}) THEN named_struct('name', '<unit>', 'word', '<unit>')
        ELSE named_struct('name', p.low, 'word', p.low) END)"""
    rows = texts.select(*keys, *[F.expr(f"regexp_extract_all(text, '{TOKEN}', {i})").alias(n) for i, n in ((2, "raw"), (1, "gaps"))])
    rows = rows.select(*keys, "raw", "gaps", F.expr("transform(raw, t -> lower(t))").alias("low"), F.expr("concat(array(''), raw)").alias("before"))
    parts = F.slice(F.arrays_zip(F.col("raw").alias("token"), F.col("gaps").alias("gap"), "low", "before"), F.lit(1), F.size("raw"))
    return rows.select(*keys, "low", parts.alias("parts")).select(*keys, "low", F.expr(forms).alias("forms")).select(*keys, "low", "forms.name", "forms.word")


def _windows(tokens: DataFrame, sizes: list[int], *keys: str) -> DataFrame:
    """(keys, w, at, code): every code, raw or of a template, of every window of w tokens, for each w of `sizes`."""
    codes = tokens.select(*keys, *[F.expr(f"transform({c}, t -> xxhash64(t))").alias(c) for c in ("low", "name", "word")])
    other = "filter(transform({a}, (t, i) -> IF(t != get({b}, i), i + 1, 0)), i -> i > 0)"
    codes = codes.select("*", F.expr(other.format(a="word", b="low")).alias("slots"), F.expr(other.format(a="name", b="word")).alias("opens"))
    # a template's window has a code of its own only where it holds a token that differs
    around = "array_distinct(flatten(transform({}, j -> sequence(greatest(1, j - {{w}} + 1), least(j, size(low) - {{w}} + 1)))))"
    starts = {"low": "sequence(1, size(low) - {w} + 1)", "word": around.format("slots"), "name": around.format("opens")}
    lists = ", ".join(f"transform({at}, i -> struct({{w}} AS w, i - 1 AS at, xxhash64(slice({c}, i, {{w}})) AS code))" for c, at in starts.items())
    every = [("CASE WHEN size(low) >= {w} THEN concat(" + lists + ") END").format(w=w) for w in sizes]
    return codes.select(*keys, F.inline(F.expr(every[0] if len(every) == 1 else "flatten(array_compact(array(" + ", ".join(every) + ")))")))


def _texts(rows: DataFrame, name: str, key: str) -> DataFrame:
    """(name, key, text): the id as a number and a number of the row's id and text, so that rows which repeat an id stay apart."""
    rows = rows.select(F.col(name).cast("long").alias(name), F.coalesce("text", F.lit("")).alias("text")).filter(F.col(name).isNotNull())
    return rows.select(name, F.xxhash64(name, "text").alias(key), "text")


def _repeats(items: DataFrame, form: str) -> DataFrame:
    """(item, <form>_repeats): a code of which slots of the template hold the same value of the same kind."""
    rows = items.select("item", F.posexplode(F.arrays_zip(F.col(form).alias("t"), "low")).alias("j", "p")).filter(IS_SLOT.format("p.t"))
    kind = F.regexp_extract("p.t", "<[a-z]+>$", 0)
    first = F.min("j").over(W.partitionBy("item", kind, "p.low"))
    rows = rows.select("item", "j", first.alias("first"))
    return rows.groupBy("item").agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("j", "first")))).alias(f"{form}_repeats"))


def _members(benchmark: DataFrame) -> DataFrame:
    """(kind, class, member, item_id, n_items, w, low, form): what texts are held against, each with its smallest item.

    A class is the template with opening words as names, of kind `name`; its finer members are of kind `word` or `low`.
    """
    items = _tokens(_texts(benchmark, "item_id", "item").distinct(), "item_id", "item").filter(F.size("low") > 0)
    items = saved(items.withColumn("w", F.least(F.size("low"), F.lit(WINDOW))), "items")
    for form in ("name", "word"):
        items = items.join(_repeats(items, form), "item", "left")
    class_ = F.xxhash64("name", F.coalesce("name_repeats", F.lit(0)))
    each = [F.struct(F.lit("name").alias("kind"), class_.alias("class"), class_.alias("member"), F.col("name").alias("form"))]
    each.append(F.struct(F.lit("word").alias("kind"), class_.alias("class"), F.xxhash64("word", F.coalesce("word_repeats", F.lit(0)), class_).alias("member"), F.col("word").alias("form")))
    each.append(F.struct(F.lit("low").alias("kind"), class_.alias("class"), F.xxhash64("low", class_).alias("member"), F.col("low").alias("form")))
    rows = items.withColumn("two", F.col("name") != F.col("word")).select("item_id", "w", "low", "two", F.inline(F.array(*each))).filter("two OR kind != 'word'")
    told = f"size(filter(form, t -> {IS_LITERAL.format('t')})) >= {LEAST_LITERALS}"
    found = rows.groupBy("kind", "class", "member").agg(F.min_by(F.struct("w", "low", "form"), F.struct("item_id", "low")).alias("m"), F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n_items"))
    return found.select("kind", "class", "member", "item_id", "n_items", "m.*").withColumn("told", F.expr(f"kind = 'low' OR {told}"))


def _judged(hits: DataFrame, wanted: DataFrame, members: DataFrame, docs: DataFrame, share: float, torn: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The members that texts hold, and the torn slots found on the way: (doc_id, doc, class, kind, member, n_windows, share) and (doc, class, line, torn).

    Only pairs with enough windows are looked at slot by slot. `torn` are slots torn before, for members without slots of their own.
    """
    pair, total = ["doc_id", "doc", "class", "kind", "member"], members.select("member", "kind", "total")
    met = hits.join(wanted, ["class", "w", "code"]).withColumn("line", F.col("at") - F.col("item_at"))
    lines = saved(met.groupBy(*pair, "w", "line").agg(F.collect_set("item_at").alias("places")), "lines")  # no more places than the item has
    each = lines.select(*pair, F.explode("places").alias("p")).groupBy(*pair).agg(F.count_distinct("p").alias("n"))
    enough = each.join(total, ["member", "kind"]).filter(F.col("n") >= share * F.col("total")).select("doc", "member", "kind")
    lines = saved(lines.join(enough, ["doc", "member", "kind"], "left_semi"), "lines")
    slotted = lines.filter("kind != 'low'")
    ids = saved(slotted.select("doc").distinct(), "texts")
    few = ids.count() * 8 <= BROADCAST_BYTES
    texts = _tokens(docs.join(F.broadcast(ids) if few else ids, "doc", "left_semi").select("doc", "text").distinct(), "doc").select("doc", F.col("low").alias("theirs"))
    covered = F.expr("array_distinct(flatten(transform(places, p -> sequence(p, p + w - 1))))")
    slots = slotted.join(texts, "doc").join(members.select("member", "kind", "low", "form"), ["member", "kind"]).select("doc", "class", "kind", "member", "line", F.explode(covered).alias("j"), "low", "form", "theirs")
    # get() before the rows grow: of the arrays only one token each goes on
    slots = slots.select("doc", "class", "kind", "member", "line", "j", F.get("form", "j").alias("t"), F.get("low", "j").alias("ours"), F.get("theirs", (F.col("j") + F.col("line")).cast("int")).alias("theirs"))
    slots = slots.filter(IS_SLOT.format("t")).withColumn("slot", F.regexp_extract("t", "<[a-z]+>$", 0))
    line = ["doc", "class", "kind", "member", "line"]
    one_way = [W.partitionBy(*line, "slot", c) for c in ("ours", "theirs")]
    apart = (F.min("theirs").over(one_way[0]) != F.max("theirs").over(one_way[0])) | (F.min("ours").over(one_way[1]) != F.max("ours").over(one_way[1]))
    own = saved(slots.withColumn("apart", apart).filter("apart").groupBy(*line).agg(F.collect_set("j").alias("torn")), "torn")
    voids = own.drop("class")
    placed = lines.join(voids, ["doc", "kind", "member", "line"], "left")
    if torn is not None:
        placed = placed.join(torn.withColumnRenamed("torn", "before"), ["doc", "class", "line"], "left")
        placed = placed.withColumn("torn", F.when(F.col("kind") == "low", F.col("before")).otherwise(F.col("torn"))).drop("before")
    sound = F.expr("array_except(places, coalesce(array_distinct(flatten(transform(torn, j -> sequence(j - w + 1, j)))), array()))")
    held = placed.select(*pair, F.explode(sound).alias("p")).groupBy(*pair).agg(F.count_distinct("p").alias("n_windows"))
    held = held.join(total, ["member", "kind"]).withColumn("share", F.col("n_windows") / F.col("total")).filter(F.col("share") >= share)
    return held.select(*pair, "n_windows", "share"), own.select("doc", "class", "line", "torn")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, n_items, n_windows, share) for each document of (doc_id, text) that holds an item of (item_id, text).

    item_id stands for the n_items ids of its class (the smallest; see the module), n_windows counts the windows met, share is their part of all
    its windows that count. Rows with null ids are left out; null and empty texts hold nothing; equal documents each give rows of
    their own. Rows that repeat an id are texts of their own, of which the best match counts. Other columns are left
    out. Empty tables give no rows.
    """
    docs = _texts(docs, "doc_id", "doc")
    members = saved(_members(benchmark), "members")
    sizes = sorted(r.w for r in members.select("w").distinct().collect())  # eight values at most
    if not sizes:
        long = F.lit(0).cast("long")
        return docs.limit(0).select("doc_id", long.alias("item_id"), long.alias("n_items"), long.alias("n_windows"), F.lit(0.0).alias("share"))
    # the window at i - 1, told by a literal token unless it is of raw tokens
    codes = "transform(sequence(1, size(form) - w + 1), i -> struct(i - 1 AS item_at, xxhash64(transform(slice(form, i, w), t -> xxhash64(t))) AS code, kind = 'low' OR exists(slice(form, i, w), t -> " + IS_LITERAL.format("t") + ") AS says))"
    wanted = saved(members.filter("told").select("kind", "class", "member", "w", F.inline(F.expr(codes))).filter("says").drop("says"), "wanted")
    members = members.join(wanted.groupBy("member", "kind").agg(F.count("*").alias("total")), ["member", "kind"])
    keys = saved(wanted.select("w", "code", "class").distinct(), "keys")
    small = keys.count() * 24 <= BROADCAST_BYTES
    seen = _windows(_tokens(docs, "doc_id", "doc"), sizes, "doc_id", "doc")
    hits = saved(seen.join(F.broadcast(keys) if small else keys, ["w", "code"]), "hits")
    whole, torn = _judged(hits, wanted.filter("kind = 'name'"), members, docs, share, None)
    whole = saved(whole, "held")
    rest = hits.join(whole.select("doc", "class"), ["doc", "class"], "left_anti")
    finer, _ = _judged(rest, wanted.filter("kind != 'name'"), members, docs, share, torn)
    found = whole.unionByName(finer).join(members.select("member", "kind", "item_id", "n_items"), ["member", "kind"])
    best = F.max(F.struct("share", "n_windows", "n_items")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_items", "best.n_windows", "best.share")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5) -> DataFrame:
    """docs, all columns, without the documents that hold an item; rows without doc_id stay."""
    found = saved(contaminated(docs, benchmark, share).select("doc_id").distinct(), "contaminated")
    few = found.count() * 8 <= BROADCAST_BYTES  # then the texts stay where they are
    return docs.join(F.broadcast(found) if few else found, "doc_id", "left_anti").select(*docs.columns)
