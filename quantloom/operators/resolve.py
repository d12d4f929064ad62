"""Entity resolution: names matched in stages, each for what the stages before left over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.text import COMPANY_WORDS, is_md5, jaccard, normalize_name, words_of
from quantloom.operators.joins import spread_join
from quantloom.sources.store import written

GRAM = 5


def tokens_for_match(name: Column) -> Column:
    """The words of a name in order, punctuation aside, without those that company names share; repeats stay."""
    plain = F.regexp_replace(normalize_name(name), "[()\\[\\].،,؛;:_/\\\\-]+", " ")
    return F.filter(words_of(plain), lambda w: ~w.isin(*COMPANY_WORDS))


def _grams(text: Column, n: Column) -> Column:
    """The distinct stretches of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n))))


def contained_pairs(inner: DataFrame, outer: DataFrame, n: int = GRAM, small: int | None = None) -> DataFrame:
    """Rows a, b of inner (a, text) and outer (b, text) where b's text holds a's, which has small characters or more, by
    default n.

    Each inner text waits at one stretch of n characters, or at itself where it is shorter, the one that fewest outer texts
    hold; each outer text looks at all of its own. So a word that all names share brings no pairs.
    """
    text, own = F.col("text"), F.col("text")
    small = n if small is None else small
    posted = outer.select("b", text.alias("whole"), F.explode(F.flatten(F.filter(
        F.array(*(_grams(own, F.lit(k)) for k in range(small, n + 1))), lambda g: g.isNotNull()))).alias("gram"))
    often = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = inner.filter(F.length("text") >= small).select("a", "text", F.explode(_grams(text, F.least(F.length("text"), F.lit(n)))).alias("gram")).join(often, "gram")
    # a text with a stretch that no outer text holds is in none; it may wait at another of its stretches all the same
    waits = rare.groupBy("a", "text").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    # an inner text waits once and an outer text looks at a stretch once, so pairs come once
    return spread_join(posted, waits, ["gram"], ["b"]).filter(F.col("whole").contains(F.col("text"))).select("a", "b")


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Rows a, b, near of left (a, words) and right (b, words): word sets with a Jaccard similarity of least or more.

    Words are ordered by how many sets hold them, rarest first. Two such sets share a word among the first
    size - ceil(least * size) + 1 of each, so the join is on these alone, and a word that all names hold is hardly ever
    among them. At their first common word, the words behind it bound how many they can share, and with it the
    similarity that a pair can reach; pairs that can't reach least go no further.
    """
    each = {k: df.select(k, F.array_distinct("words").alias("words")).select(k, F.size("words").alias(f"n_{k}"), F.explode("words").alias("word")) for k, df in (("a", left), ("b", right))}
    often = each["a"].select("word").unionAll(each["b"].select("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def head(k: str) -> DataFrame:
        size, place = F.col(f"n_{k}"), F.row_number().over(Window.partitionBy(k).orderBy("n", "word"))
        return each[k].join(often, "word").withColumn("place", place).filter(F.col("place") <= size - F.ceil(size * F.lit(least) - 1e-9) + 1).select(k, "word", size, (size - F.col("place")).alias(f"rest_{k}"))

    shared = F.least("rest_a", "rest_b") + 1  # at most
    pairs = spread_join(head("a"), head("b"), ["word"], ["a"]).filter(
        (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least) - 1e-9) & (shared >= F.lit(least) * (F.col("n_a") + F.col("n_b") - shared) - 1e-9)).select("a", "b").distinct()
    near = jaccard(F.col("left"), F.col("right"))
    both = pairs.join(left.select("a", F.col("words").alias("left")), "a").join(right.select("b", F.col("words").alias("right")), "b")
    return both.withColumn("near", near).filter(F.col("near") >= least).select("a", "b", "near")


#: Words of a set whose subsets are listed: 2 to this power rows a set at most.
FEW_WORDS = 8


def nearest_sets(left: DataFrame, right: DataFrame, least: float, few: int = FEW_WORDS) -> DataFrame:
    """Rows a, b, near of left (a, words): the set of right (b, words) of the greatest Jaccard similarity, from least on, the
    smaller b of equals. Sets that share no word match nothing.

    No pair of sets is formed. Of all sets of right that hold a subset of words only the smallest can be nearest to a
    set that shares just these, so right is listed by subset, of which the smallest set stays, before the shuffle, and a
    set of left looks up its own subsets. Both list only subsets of so many words that least can be reached. Sets of
    over `few` words on either side go through similar_pairs instead.
    """
    sets = {k: df.select(k, F.array_sort(F.array_distinct("words")).alias("words")).withColumn("n", F.size("words")).filter("n > 0") for k, df in (("a", left), ("b", right))}

    def subsets(k: str) -> DataFrame:
        bits = F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.col("n")) - 1).cast("int"))
        chosen = F.filter(bits, lambda i: F.bit_count(i) >= F.col("n") * F.lit(least) - 1e-9)
        rows = sets[k].filter(F.col("n") <= few).select(k, "n", "words", F.explode(chosen).alias("i"))
        held = F.filter("words", lambda w, at: F.getbit(F.col("i"), at) == 1)
        return rows.select(k, "n", held.alias("subset"))

    smallest = subsets("b").groupBy("subset").agg(F.min(F.struct("n", "b")).alias("r"))
    met = spread_join(subsets("a"), smallest, ["subset"], ["a"])
    size = F.size("subset")
    near = met.select("a", F.col("r.b").alias("b"), (size / (F.col("n") + F.col("r.n") - size)).alias("near")).filter(F.col("near") >= F.lit(least) - 1e-12)
    long = lambda k: sets[k].filter(F.col("n") > few).select(k, "words")
    few_left = sets["a"].filter(F.col("n") <= few).select("a", "words")
    for one, other in ((long("a"), right), (few_left, long("b"))):
        near = near.unionByName(similar_pairs(one, other, least))
    return near.groupBy("a").agg(F.min(F.struct((-F.col("near")).alias("far"), "b")).alias("r")).select("a", "r.b", (-F.col("r.far")).alias("near"))


def resolve(names: DataFrame, known: DataFrame, overrides: DataFrame | None = None, symbols: DataFrame | None = None,
            threshold: float = 0.75, min_tokens: int = 2, min_chars: int = GRAM) -> DataFrame:
    """Rows name_id, company_id, how of the rows of names (name_id, symbol, name) that one of seven stages matches:

    override(id) and override(name), by the symbol in overrides (symbol, value), where the value is a company's MD5 id or
    its name; exact-name; symbol-equals-name; stored-symbol, by symbols (symbol, company_id); containment, where one of the
    two names without common words holds the other, both having min_tokens words and min_chars characters; fuzzy, the
    greatest Jaccard similarity of words from threshold on.

    known: company_id (text), company_name. Each stage takes what the stages before left over, and names of one normal form
    are matched once. Ties go to the smaller company_id. Null and empty names and symbols match nothing.
    """
    asked = names.select("name_id", F.nullif(normalize_name(F.col("symbol")), F.lit("")).alias("symbol"), F.nullif(normalize_name(F.col("name")), F.lit("")).alias("name"))
    have = known.select(F.col("company_id").cast("string").alias("company_id"), normalize_name(F.col("company_name")).alias("known")).filter("known <> ''")
    by_name = have.groupBy("known").agg(F.min("company_id").alias("company_id"))
    ways = []
    if overrides is not None:
        said = overrides.select(normalize_name(F.col("symbol")).alias("symbol"), "value").dropDuplicates(["symbol"])
        by_id = said.filter(is_md5(F.col("value"))).select("symbol", F.col("value").alias("company_id"))
        ways.append(("override(id)", ["symbol"], by_id))
        named = said.filter(~is_md5(F.col("value"))).select("symbol", normalize_name(F.col("value")).alias("known")).join(by_name, "known")
        ways.append(("override(name)", ["symbol"], named.select("symbol", "company_id")))
    ways.append(("exact-name", ["name"], by_name.withColumnRenamed("known", "name")))
    ways.append(("symbol-equals-name", ["symbol"], by_name.withColumnRenamed("known", "symbol")))
    if symbols is not None:
        stored = symbols.select(normalize_name(F.col("symbol")).alias("symbol"), F.col("company_id").cast("string")).filter("symbol <> '' AND company_id IS NOT NULL")
        ways.append(("stored-symbol", ["symbol"], stored.groupBy("symbol").agg(F.min("company_id").alias("company_id"))))
    tried = asked.select("symbol", "name").distinct()
    for k, (_, on, found) in enumerate(ways):
        tried = tried.join(found.withColumnRenamed("company_id", f"id{k}"), on, "left")
    how = F.coalesce(*(F.when(F.col(f"id{k}").isNotNull(), F.lit(way)) for k, (way, _, _) in enumerate(ways)))
    tried = written(tried.select("symbol", "name", F.coalesce(*(f"id{k}" for k in range(len(ways)))).alias("company_id"), how.alias("how")), "resolve-exact")
    done, left = tried.filter("company_id IS NOT NULL"), tried.filter("company_id IS NULL").select("symbol", "name")

    rest = left.select("name").filter("name IS NOT NULL").distinct().withColumn("words", tokens_for_match(F.col("name")))
    rest = rest.withColumn("text", F.array_join("words", " "))
    cand = by_name.select("company_id", tokens_for_match(F.col("known")).alias("words")).withColumn("text", F.array_join("words", " "))
    long = (F.size("words") >= min_tokens) & (F.length("text") >= min_chars)
    mine, theirs = rest.filter(long).select("name", "text"), cand.filter(long).select("company_id", "text")
    within = contained_pairs(mine.select(F.col("name").alias("a"), "text"), theirs.select(F.col("company_id").alias("b"), "text"), min_chars)
    around = contained_pairs(theirs.select(F.col("company_id").alias("a"), "text"), mine.select(F.col("name").alias("b"), "text"), min_chars)
    held = within.select(F.col("a").alias("name"), F.col("b").alias("company_id")).unionByName(around.select(F.col("b").alias("name"), F.col("a").alias("company_id")))
    held = written(held.groupBy("name").agg(F.min("company_id").alias("company_id")).withColumn("how", F.lit("containment")), "resolve-contained")
    last = rest.join(held.select("name"), "name", "left_anti").select(F.col("name").alias("a"), "words")
    near = nearest_sets(last, cand.select(F.col("company_id").alias("b"), "words"), threshold)
    near = near.select(F.col("a").alias("name"), F.col("b").alias("company_id"), F.lit("fuzzy").alias("how"))
    late = left.join(held.unionByName(near), "name").select("symbol", "name", "company_id", "how")
    found = done.unionByName(late)
    same = asked["symbol"].eqNullSafe(found["symbol"]) & asked["name"].eqNullSafe(found["name"])
    return asked.join(found, same).select("name_id", "company_id", "how")


def search(queries: DataFrame, listed: DataFrame, least: float = 0.4, name_chars: int = 4) -> DataFrame:
    """Rows query_id, item_id, how of queries (query_id, text) that listed (item_id, symbol, name) answers: exact, where the
    text is a symbol or a name; substring, where a symbol holds the text or the text a symbol, or the same with a name for
    texts of name_chars characters and more; fuzzy, the greatest Jaccard similarity of words from least on.

    What one stage answers the next is not asked. Ties go to the smaller item_id. Null and empty texts find nothing.
    """
    asked = written(queries.select("query_id", F.nullif(normalize_name(F.col("text")), F.lit("")).alias("text")), "search-asked")
    both = listed.select("item_id", normalize_name(F.col("symbol")).alias("symbol"), normalize_name(F.col("name")).alias("name"))
    # of items by one symbol or name only the least can be an answer
    own = both.select("item_id", F.lit(1).alias("least"), F.col("symbol").alias("own")).unionByName(
        both.select("item_id", F.lit(name_chars).alias("least"), F.col("name").alias("own"))).filter("own <> ''").groupBy("own", "least").agg(F.min("item_id").alias("item_id"))
    own = written(own, "search-listed")
    best = lambda df: df.groupBy("text").agg(F.min("item_id").alias("item_id"))
    exact = best(asked.select("text").filter("text IS NOT NULL").distinct().join(own.withColumnRenamed("own", "text"), "text"))
    exact = written(exact.withColumn("how", F.lit("exact")), "search-exact")
    rest = written(asked.select("text").filter("text IS NOT NULL").distinct().join(exact, "text", "left_anti"), "search-rest")

    # a text of few characters is itself a stretch of what holds it: the least item a stretch, before any join
    stretches = own.select("item_id", "least", F.explode(F.flatten(F.filter(F.array(*(_grams(F.col("own"), F.lit(k)) for k in (1, 2, 3))), lambda g: g.isNotNull()))).alias("text"))
    short = best(rest.filter(F.length("text") <= 3).join(stretches.filter(F.length("text") >= F.col("least")).groupBy("text").agg(F.min("item_id").alias("item_id")), "text"))
    strings = own.select(F.struct("item_id", "least").alias("item"), F.col("own").alias("text"))
    within = contained_pairs(rest.filter(F.length("text") > 3).select(F.col("text").alias("a"), "text"), strings.withColumnRenamed("item", "b"), 3).toDF("text", "item")
    around = contained_pairs(strings.withColumnRenamed("item", "a"), rest.select(F.col("text").alias("b"), "text"), 3, 1).toDF("item", "text")
    held = within.unionByName(around).filter(F.length("text") >= F.col("item.least")).select("text", F.col("item.item_id").alias("item_id"))
    held = written(best(held.unionByName(short)).withColumn("how", F.lit("substring")), "search-held")
    rest = rest.join(held, "text", "left_anti")
    near = nearest_sets(rest.select(F.col("text").alias("a"), tokens_for_match(F.col("text")).alias("words")),
                        both.select(F.col("item_id").alias("b"), tokens_for_match(F.col("name")).alias("words")), least)
    near = near.select(F.col("a").alias("text"), F.col("b").alias("item_id"), F.lit("fuzzy").alias("how"))
    return asked.join(exact.unionByName(held).unionByName(near), "text").select("query_id", "item_id", "how")
