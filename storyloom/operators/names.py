"""Names that may be slips of one another, and marks counted in sliding windows of a text.

Names meet over a neighbourhood of deletions: a name is written with each of its places but the first masked in turn, and two
names that agree in length and in one masked form differ in that place at most. So only names that are alike are ever
joined. Windows count hits, not characters: a text is searched once for all marks, and a hit knows the windows that hold it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.columns import literal, rounded

# Frequent surnames; a longer list is a parameter.
SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅"
# Words that look like names.
NO_NAMES = "他们 我们 你们 什么 怎么 没有 可以 这个 那个 自己 因为 所以 如果 虽然 但是 已经 还是 或者 而且 不过 只是".split()
HAN_NAME = "[一-鿿]{2,3}"


def name_counts(texts: DataFrame, key: str, text: str = "text", pattern: str = HAN_NAME, surnames: Sequence[str] | str = SURNAMES, skip: Sequence[str] = tuple(NO_NAMES)) -> DataFrame:
    """(key, name, n): runs that match the pattern, begin with a surname and hold none of the words to skip."""
    found = texts.select(key, F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({pattern})"), 1)).alias("name"))
    kept = found.where(F.left("name", F.lit(1)).isin(list(surnames)))
    if skip:
        kept = kept.where(~F.col("name").rlike("|".join(map(literal, skip))))
    return kept.groupBy(key, "name").agg(F.count("*").alias("n"))


def similar_pairs(names: DataFrame, key: str) -> DataFrame:
    """(key, a, b, n_a, n_b), a < b: names of one length and first letter that differ in one place."""
    places = F.sequence(F.lit(2), F.greatest(F.length("name"), F.lit(2)))
    masked = F.transform(places, lambda i: F.overlay("name", F.lit("\0"), i))
    met = names.where(F.length("name") > 2).select(key, "name", "n", F.explode(masked).alias("mask"))
    left, right = met.select(key, "mask", F.col("name").alias("a"), F.col("n").alias("n_a")), met.select(key, "mask", F.col("name").alias("b"), F.col("n").alias("n_b"))
    return left.join(right, [key, "mask"]).where("a < b").select(key, "a", "b", "n_a", "n_b")


def rare_names(names: DataFrame, key: str, length: int = 3, least: int = 20, often: int = 3) -> DataFrame:
    """(key, name): names of `length` letters met once, in texts with over `least` names, where another of that first letter and length is met `often`."""
    own = Window.partitionBy(key)
    kin = Window.partitionBy(key, F.left("name", F.lit(1)), F.length("name"))
    marked = names.withColumns({"total": F.sum("n").over(own), "most": F.max("n").over(kin)})
    return marked.where((F.col("n") == 1) & (F.length("name") == length) & (F.col("total") > least) & (F.col("most") >= often)).select(key, "name")


def name_consistency(texts: DataFrame, key: str, **options) -> DataFrame:
    """(key, n_names, n_rare, n_pairs, score) of every text: 100 less five for each rare name and three for each pair that is alike."""
    names = name_counts(texts, key, **options)
    each = names.groupBy(key).agg(F.count("*").alias("n_names"))
    rare = rare_names(names, key).groupBy(key).agg(F.count("*").alias("n_rare"))
    pairs = similar_pairs(names, key).groupBy(key).agg(F.count("*").alias("n_pairs"))
    rows = texts.select(key).join(each, key, "left").join(rare, key, "left").join(pairs, key, "left").fillna(0)
    return rows.withColumn("score", F.greatest(F.lit(0), 100 - 5 * F.col("n_rare") - 3 * F.col("n_pairs")))


def hit_places(text: Column, words: Sequence[str]) -> Column:
    """An array of (word, place from 0) of all occurrences of the words, overlapping ones too.

    One regular expression cuts the text before each place where any word begins; the pieces' lengths summed up are the places.
    """
    begins = "(?=" + "|".join(literal(w) for w in sorted(set(words))) + ")"
    known = F.array(*[F.lit(w) for w in sorted(set(words))])
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("places"))

    most = max(map(len, words))

    def of(pieces: Column) -> Column:
        add = lambda s, p: F.struct((s["end"] + F.length(p)).alias("end"), F.concat(s["places"], F.array(s["end"])).alias("places"))
        places = F.aggregate(pieces, zero, add, lambda s: s["places"])
        heads = F.transform(pieces, lambda p: F.left(p, F.lit(most)))  # a word may reach over the pieces after its own, which hold a letter each at least
        starts = F.transform(heads, lambda _, i: F.array_join(F.slice(heads, i + 1, most), ""))
        return F.flatten(F.zip_with(places, starts, lambda at, begin: F.transform(F.filter(known, lambda w: F.startswith(begin, w)), lambda w: F.struct(w.alias("word"), at.alias("at")))))

    return F.flatten(F.transform(F.array(F.split(text, begins, -1)), of))  # bound once, else each look at the pieces would cut the text again


def window_density(texts: DataFrame, key: str, words: Sequence[str], text: str = "text", letters: str = "[^一-鿿]", size: int = 100, stride: int = 50) -> DataFrame:
    """(key, n_windows, density) of every text: of its letters only, the largest share of different words in a window. A text of up to `size` letters has no window."""
    low = texts.select(key, F.regexp_replace(F.coalesce(F.col(text), F.lit("")), letters, "").alias("t"))
    n_windows = F.greatest(F.ceil((F.length("t") - size) / stride), F.lit(0)).cast("long")
    rows = low.select(key, n_windows.alias("n_windows"), F.when(F.length("t") > size, hit_places(F.col("t"), words)).alias("hits"))
    each = rows.select(key, "n_windows", F.explode("hits").alias("h")).select(key, "n_windows", F.col("h.word").alias("word"), F.col("h.at").alias("at"))
    first = F.greatest(F.ceil((F.col("at") + F.length("word") - size) / stride), F.lit(0)).cast("long")
    last = F.least(F.floor(F.col("at") / stride).cast("long"), F.col("n_windows") - 1)
    held = each.withColumns({"first": first, "last": last}).where("first <= last").select(key, "word", F.explode(F.sequence("first", "last")).alias("window"))
    most = held.distinct().groupBy(key, "window").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("n"))
    return rows.select(key, "n_windows").join(most, key, "left").select(key, "n_windows", rounded(F.coalesce("n", F.lit(0)) / size, 4).alias("density"))
