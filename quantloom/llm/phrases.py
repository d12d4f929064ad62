"""Phrase collocations: candidates in broadcast double-array tries, all text positions advanced at once, accepting states counted.

Texts are turned once into vectors of word codes, with a zero between pieces. Level by level, phrases whose words before
the last and whose words after the first are candidates already, and that occur often enough, become candidates. In the
end one trie of all of them, or a few where there are many, counts every candidate in one pass over the codes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import join_split, materialize, running, small_batches, table

LEAST = 30
LONGEST = 4
TOP = 2000
SCALE = 2_000_000
#: A candidate goes where a longer one that holds it has this part of its count, in hundredths.
ABSORBED = 80
#: Candidates of one trie: the bound of what is broadcast at a time.
TRIE_PHRASES = 500_000
#: Positions of one vector of codes, and words that a task remembers at a time. A vector is a row, and tables are written and
#: read a hundred rows at a time and more, so it is small.
VECTOR, WORDS = 1 << 16, 500_000
#: Positions that go through a trie at once, and places of extensions that a task counts together.
AT_ONCE, PLACES = 1 << 18, 1 << 21
#: Vectors whose words are counted together.
VECTORS_COUNTED = 16
FAN = 256
BREAK = b"\xff"  # in no UTF-8 text
#: Lower-cases A-Z and turns what ends a piece into a break.
FOLD = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def split_words(text: str) -> list[bytes]:
    """The words of a text in order, with a break wherever a piece ends."""
    return text.encode().translate(FOLD).replace(BREAK, b" \xff ").split()


class Words(dict):
    """Numbers for the words of a language, and their codes, as they come."""

    def __init__(self, lang: str, codes: array, seed: int) -> None:
        super().__init__({BREAK: 0})
        self.head, self.codes, self.seed = f"{len(lang)}:{lang}".encode(), codes, seed

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(self.head + word, self.seed)
        self.codes.append((code or 1) - (1 << 64) * (code >> 63))
        self[word] = len(self.codes) - 1
        return self[word]


def encode(texts: DataFrame, seed: int) -> DataFrame:
    """Rows codes (64-bit integers), or lang, word, code, n: the texts' vectors of codes, and each task's words and how often they came.

    A code belongs to a word of a language. A vector ends at the end of a piece, after about VECTOR positions.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, langs, held, size, counts, uncounted = array("q", [0]), {}, [], 0, np.zeros(1, np.int64), []

        def vector() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                ids = np.concatenate(held)
                held, size = [], 0
                uncounted.append(ids)
                if len(uncounted) >= VECTORS_COUNTED:
                    count()
                yield rows(codes=[np.frombuffer(codes, np.int64)[ids].tobytes()])

        def count() -> None:
            nonlocal counts
            if uncounted:
                own = np.bincount(np.concatenate(uncounted), minlength=len(codes))
                own[:len(counts)] += counts
                counts = own
                uncounted.clear()

        def words() -> Iterator[pa.RecordBatch]:
            nonlocal codes, langs, counts
            count()
            for lang, known in langs.items():
                names, at = list(known)[1:], np.fromiter(known.values(), np.int64, len(known))[1:]
                for k in range(0, len(names), 50_000):
                    own = at[k:k + 50_000]
                    yield rows(lang=[lang] * len(own), word=[w.decode() for w in names[k:k + 50_000]], code=np.frombuffer(codes, np.int64)[own], n=counts[own])
            codes, langs, counts = array("q", [0]), {}, np.zeros(1, np.int64)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = langs.get(lang)
                if known is None:
                    known = langs[lang] = Words(lang, codes, seed)
                found = split_words(text)
                ids = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
                for part in parts(ids, VECTOR):
                    held += [part, np.zeros(1, np.int32)]
                    size += len(part) + 1
                    if size >= VECTOR:
                        yield from vector()
                if len(codes) > WORDS:
                    yield from vector()
                    yield from words()
        yield from vector()
        yield from words()

    return texts.mapInArrow(task, "codes binary, lang string, word string, code long, n long")


def rows(codes=None, lang=None, word=None, code=None, n=None) -> pa.RecordBatch:
    size = len(codes if codes is not None else lang)
    kinds = {"codes": (codes, pa.binary()), "lang": (lang, pa.string()), "word": (word, pa.string()), "code": (code, pa.int64()), "n": (n, pa.int64())}
    return pa.RecordBatch.from_arrays([pa.nulls(size, t) if v is None else pa.array(v, t) for v, t in kinds.values()], list(kinds))


def parts(ids: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text's numbers cut at breaks, so that a part has `most` or few more; a piece is never cut."""
    if len(ids) <= most:
        yield ids
        return
    ends, start = np.flatnonzero(ids == 0), 0
    while start < len(ids):
        at = np.searchsorted(ends, start + most)
        end = int(ends[at]) if at < len(ends) else len(ids)
        yield ids[start:end]
        start = end + 1


class Trie:
    """A double-array trie of phrases, which are tuples of word codes: state t's child by a symbol is base[t] + symbol if check there is t.

    Words are numbered by their place in `alphabet`, and a number's base-256 digits are the symbols, highest first, so no
    state has more than 256 children. States of many children are placed first, at random places where all fit; the
    arrays grow when too few do.
    """

    def __init__(self, alphabet: np.ndarray, base: np.ndarray, check: np.ndarray, entry: np.ndarray, depth: int) -> None:
        self.alphabet, self.base, self.check, self.entry, self.depth = alphabet, base, check, entry, depth
        self.digits = digits_of(len(alphabet))

    @classmethod
    def of(cls, flat: np.ndarray, sizes: np.ndarray) -> Trie:
        """From phrases one after another, of these numbers of words. Entry k + 1 is phrase k."""
        alphabet, words = np.unique(flat, return_inverse=True)
        depth, digits = int(sizes.max(initial=0)), digits_of(len(alphabet))
        starts = np.cumsum(sizes) - sizes
        node, accept = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        parents, symbols, made = [], [], 1
        for level in range(depth):
            on = np.flatnonzero(sizes > level)
            for digit in range(digits - 1, -1, -1):
                key, at = np.unique(node[on] * FAN + (words[starts[on] + level] >> 8 * digit & 255), return_inverse=True)
                parents.append(key // FAN)
                symbols.append(key % FAN)
                node[on] = made + at
                made += len(key)
            ended = on[sizes[on] == level + 1]
            accept[ended] = node[ended]
        parents, symbols = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, symbols))
        base, slot = placed(parents, symbols, made)
        size = max(int(slot.max()), int(base.max())) + FAN + 1
        out_base, check, entry = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
        out_base[slot] = base
        check[slot[1:]] = slot[parents]
        entry[slot[accept]] = np.arange(1, len(sizes) + 1)
        return cls(alphabet, out_base, check, entry, depth)

    def advance(self, codes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """After each word, up to depth: the positions at which the trie goes on so far, and their states, all at once."""
        if not len(self.alphabet):
            return
        at = np.searchsorted(self.alphabet, codes)
        at[at == len(self.alphabet)] = 0
        word = np.where(self.alphabet[at] == codes, at, -1)
        word = np.append(word, np.full(depth, -1))
        position = np.flatnonzero(word >= 0)
        state = np.zeros(len(position), np.int64)
        for level in range(depth):
            now = word[position + level]
            on = now >= 0
            position, state, now = position[on], state[on], now[on]
            for digit in range(self.digits - 1, -1, -1):
                following = self.base[state] + (now >> 8 * digit & 255)
                on = self.check[following] == state
                position, state, now = position[on], following[on], now[on]
            yield position, state

    def phrases(self) -> int:
        return int(self.entry.max(initial=0))

    def add_counts(self, codes: np.ndarray, total: np.ndarray) -> None:
        """Add how often each entry occurs; entry 0 is what is no phrase."""
        found = [self.entry[state] for _, state in self.advance(codes, self.depth)]
        if found:
            total += np.bincount(np.concatenate(found), minlength=len(total))

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """How often each phrase occurs."""
        total = np.zeros(self.phrases() + 1, np.int64)
        self.add_counts(codes, total)
        return total[1:]


def digits_of(words: int) -> int:
    return max(1, -(-max(1, words - 1).bit_length() // 8))


def placed(parents: np.ndarray, symbols: np.ndarray, states: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Each state's base and slot, such that children have slots of their own; the root has slot 0."""
    base, slot, draw = np.zeros(states, np.int64), np.zeros(states, np.int64), np.random.default_rng(seed)
    children = np.bincount(parents, minlength=states)
    order = np.argsort(parents, kind="stable")  # child k is state k + 1
    first = np.cumsum(children) - children
    size = 4 * FAN + 2 * states
    used = np.zeros(size, bool)
    used[0] = True
    for width in range(9, 0, -1):
        open_states = np.flatnonzero((children >= 1 << width - 1) & (children < 1 << width))
        tried = 0
        while len(open_states):
            own = children[open_states]
            owner = np.repeat(np.arange(len(open_states)), own)
            child = order[np.repeat(first[open_states] - (np.cumsum(own) - own), own) + np.arange(len(owner))]
            start = draw.integers(0, size - FAN, len(open_states))
            wanted = start[owner] + symbols[child]
            clash = used[wanted]
            _, one = np.unique(wanted, return_index=True)  # of those that want the same slot the first has it
            alone = np.zeros(len(wanted), bool)
            alone[one] = True
            good = np.bincount(owner, clash | ~alone, minlength=len(open_states)) == 0
            base[open_states[good]] = start[good]
            mine = good[owner]
            slot[child[mine] + 1] = wanted[mine]
            used[wanted[mine]] = True
            open_states, tried = open_states[~good], tried + 1
            if good.mean() < 0.02 and tried > 8:
                used = np.append(used, np.zeros(max(FAN * 4, min(FAN * len(open_states), size // 4)), bool))
                size, tried = len(used), 0
    return base, slot


def tries_of(phrases: DataFrame, most: int) -> DataFrame:
    """Rows trie, alphabet, base, check, entry, depth of phrases (id, codes), whose ids are 0, 1, ...: trie k holds those from k * most on."""
    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        codes = group.column("codes").combine_chunks()
        trie = Trie.of(codes.flatten().to_numpy(), codes.value_lengths().to_numpy())
        return pa.table({
            "trie": group.column("trie").slice(0, 1), **{n: pa.array([getattr(trie, n).tobytes()], pa.binary()) for n in ("alphabet", "base", "check", "entry")},
            "depth": pa.array([trie.depth], pa.int32())})

    kinds = "trie long, alphabet binary, base binary, check binary, entry binary, depth int"
    dealt = phrases.select(F.floor(F.col("id") / most).alias("trie"), "id", "codes")
    return materialize(dealt.groupBy("trie").applyInArrow(build, kinds), "phrase-tries")


def broadcast_tries(phrases: DataFrame, most: int):
    """One broadcast trie after another, with the id of its first phrase and how many tries there are."""
    spark = phrases.sparkSession
    tries = tries_of(phrases, most)
    count = tries.count()
    for k in range(count):
        row = tries.filter(F.col("trie") == k).first()
        if row:
            arrays = [np.frombuffer(row["alphabet"], np.int64), *(np.frombuffer(row[n], np.int32) for n in ("base", "check", "entry"))]
            yield spark.sparkContext.broadcast((*arrays, row["depth"])), k * most, count


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The codes of vectors, several together; each ends at a break, so no phrase crosses from one to the next."""
    held, size = [], 0
    for batch in batches:
        for raw in batch.column(0):
            held.append(np.frombuffer(raw.as_py(), np.int64))
            size += len(held[-1])
            if size >= AT_ONCE:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


class Extensions:
    """Counts of which phrase is followed by which word, of PLACES places together."""

    def __init__(self, of: Trie, size: int, low: int, single: bool) -> None:
        self.of, self.size, self.low, self.single = of, size, low, single
        self.tail = np.zeros(of.phrases() + 1, np.int64)  # the last word of each phrase, as far as it has come
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.places = 0

    def add(self, codes: np.ndarray) -> None:
        at = np.zeros(len(codes) + 1, np.int64)
        for level, (position, state) in enumerate(self.of.advance(codes, self.size)):
            if level == self.size - 1:
                at[position] = self.of.entry[state]
        last = np.append(codes[self.size:], np.zeros(self.size, np.int64))
        on = np.flatnonzero((at[:-1] > 0) & (last != 0) & ((at[1:] > 0) | (not self.single)))
        if self.single:  # the phrase after the first word tells the word
            self.tail[at[on + 1]] = last[on]
            self.held.append((at[on] * len(self.tail) + at[on + 1], last[:0]))
        else:
            self.held.append((at[on], last[on]))
        self.places += len(on)

    def counted(self) -> pa.RecordBatch:
        first, last = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.places = [], 0
        if self.single:
            key, n = np.unique(first, return_counts=True)
            entry, code = key // len(self.tail), self.tail[key % len(self.tail)]
        else:
            names, number = np.unique(last, return_inverse=True)
            key, n = np.unique(first * max(1, len(names)) + number, return_counts=True)
            entry, code = key // max(1, len(names)), names[key % max(1, len(names))] if len(names) else key
        return pa.RecordBatch.from_arrays([pa.array(self.low - 1 + entry), pa.array(code), pa.array(n)], ["id", "code", "n"])


def longer(vectors: DataFrame, phrases: DataFrame, size: int, most: int) -> DataFrame:
    """Rows id, code, n: how often a word follows a phrase of `size` words, of the phrases (id, codes).

    With one trie, only where the words after the first are a phrase too; with several, that is left to the count, which
    such an extension of a rare phrase can't reach.
    """
    found = None
    for trie, low, count in broadcast_tries(phrases, most):
        def task(batches: Iterator[pa.RecordBatch], trie=trie, low=low, single=count == 1) -> Iterator[pa.RecordBatch]:
            seen = Extensions(Trie(*trie.value), size, low, single)
            for codes in stretches(batches):
                seen.add(codes)
                if seen.places >= PLACES:
                    yield seen.counted()
            if seen.places:
                yield seen.counted()

        own = vectors.mapInArrow(task, "id long, code long, n long")
        found = own if found is None else found.unionAll(own)
    return found


def counted(vectors: DataFrame, phrases: DataFrame, most: int) -> DataFrame:
    """Rows id, n: how often each phrase of (id, codes) occurs, as each task counts it."""
    found = None
    for trie, low, _ in broadcast_tries(phrases, most):
        def task(batches: Iterator[pa.RecordBatch], trie=trie, low=low) -> Iterator[pa.RecordBatch]:
            of = Trie(*trie.value)
            total = np.zeros(of.phrases() + 1, np.int64)
            for codes in stretches(batches):
                of.add_counts(codes, total)
            on = np.flatnonzero(total[1:])
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(low + on), pa.array(total[on + 1])], ["id", "n"])

        own = vectors.mapInArrow(task, "id long, n long")
        found = own if found is None else found.unionAll(own)
    return found


def numbered(phrases: DataFrame, name: str) -> DataFrame:
    """Phrases (lang, words, codes) with id, from 0 in the order of their codes, written."""
    return materialize(running(phrases, [F.col("codes")], {"id": F.lit(1).cast("long")}, name), name)


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed: int = ABSORBED, most: int = TRIE_PHRASES,
         text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows lang, rank, phrase, a, l, r, n, score: each language's collocations of 2 to `longest` words, best first.

    A phrase counts where its words follow each other within a piece, overlaps included, and is taken from `least` on.
    Of its cuts in two the one of the lowest score, floor(2,000,000 a / (l + r)), stands, the earliest of equals. A phrase
    that a longer one of `absorbed` hundredths of its count holds is dropped. Order is by score, count, then phrase.

    Null text has no words, null lang is `und`; ids don't matter and repeated rows count each. No word, no row: an empty table
    gives none. Word codes are 64-bit hashes; if two words of one code come often enough to matter, all is encoded anew
    with another seed. A trie holds `most` candidates at most and is what is broadcast; where there are more, several
    tries go over the codes in turn. Only such tries and counts a partition pass through the driver.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    for seed in range(100):
        encoded = materialize(encode(texts, seed), "phrase-codes")
        words = materialize(encoded.filter("codes IS NULL").groupBy("lang", "word", "code").agg(F.sum("n").alias("n")), "phrase-words")
        if words.groupBy("code").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).filter((F.col("k") > 1) & (F.col("n") >= least)).isEmpty():
            break
    vectors = encoded.filter("codes IS NOT NULL").select("codes")
    frequent = words.filter(F.col("n") >= least)
    level = frequent.select("lang", F.array("word").alias("words"), F.array("code").alias("codes"))
    levels = [level]
    for size in range(1, longest):
        known = numbered(level, f"phrases-{size}")
        pairs = longer(vectors, known.select("id", "codes"), size, most)
        if pairs is None:
            break
        # tasks have counted already, so rows are dealt before they are added up: nearly all pairs are rare
        pairs = materialize(pairs.repartition("id", "code").groupBy("id", "code").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("id", "code"), f"phrase-pairs-{size}")
        named = materialize(join_split(pairs, known, ["id"], ["code"]).drop("id"), f"phrase-heads-{size}")
        named = join_split(named, frequent.select("code", "word"), ["code"], ["codes"])
        level = materialize(named.select("lang", F.concat("words", F.array("word")).alias("words"), F.concat("codes", F.array("code")).alias("codes")), f"phrase-level-{size + 1}")
        levels.append(level)
    phrases = levels[0]
    for other in levels[1:]:
        phrases = phrases.unionAll(other)
    phrases = numbered(phrases, "phrases")
    found = counted(vectors, phrases.select("id", "codes"), most)
    if found is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    phrases = materialize(phrases.join(found.groupBy("id").agg(F.sum("n").alias("a")), "id").filter(F.col("a") >= least), "phrase-counts")
    return ranked(phrases, words.groupBy("lang").agg(F.sum("n").alias("n")), top, absorbed)


def ranked(phrases: DataFrame, totals: DataFrame, top: int, absorbed: int) -> DataFrame:
    """The rows of `mine` from counted phrases (id, lang, words, codes, a) of one word and more."""
    whole, cut, at = F.col("codes"), F.col("cut"), F.size("codes")
    several = phrases.filter(at > 1)
    cuts = several.select("id", "a", "codes", F.explode(F.sequence(F.lit(1), at - 1)).alias("cut"))
    sides = cuts.select("id", "a", "cut", F.posexplode(F.array(F.slice(whole, F.lit(1), cut), F.slice(whole, cut + 1, at - cut))).alias("side", "codes"))
    sides = join_split(sides, phrases.select("codes", F.col("a").alias("f")), ["codes"], ["id", "cut"])
    both = sides.groupBy("id", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    both = both.withColumn("score", F.call_function("div", F.lit(SCALE).cast("decimal(8,0)") * wide("a"), wide("l") + wide("r")))
    scored = both.groupBy("id").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = several.filter(at > 2).select(F.col("a").alias("f"), "codes", F.explode(F.sequence(F.lit(2), at - 1)).alias("size"))
    inner = inner.select("f", "size", "codes", F.explode(F.sequence(F.lit(1), at - F.col("size") + 1)).alias("from"))
    holds = inner.groupBy(F.slice("codes", F.col("from"), F.col("size")).alias("codes")).agg(F.max("f").alias("held"))
    kept = several.join(holds, "codes", "left").filter(F.col("held").isNull() | (100 * F.col("held") < absorbed * F.col("a")))
    out = kept.join(scored, "id").select("lang", F.concat_ws(" ", "words").alias("phrase"), "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = out.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # the best of a part of a language first
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "deal")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return near.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
sized AS (SELECT *, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS k FROM starts),
grams AS (SELECT lang, w[i:i + k - 1] AS p, k FROM sized),
freq AS (SELECT lang, p, k, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM freq WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, p, k, f AS a FROM freq WHERE k > 1 AND f >= 30),
sides AS (
  SELECT lang, p, a, cut, p[1:cut] AS head, p[cut + 1:] AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)),
cuts AS (
  SELECT s.*, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM sides s JOIN freq x ON x.lang = s.lang AND x.p = s.head JOIN freq y ON y.lang = s.lang AND y.p = s.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
sizes AS (SELECT *, unnest(range(2, k)) AS size FROM cand WHERE k > 2),
places AS (SELECT *, unnest(range(1, k - size + 2)) AS i FROM sizes),
held AS (SELECT lang, p[i:i + size - 1] AS p, max(a) AS f FROM places GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.p = b.p WHERE h.f IS NULL OR 100 * h.f < 80 * b.a),
named AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named) JOIN total USING (lang)
WHERE rank <= 2000
"""
