"""Stock phrases of generated texts, and how much a text reads as if a person had written it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.columns import dense, ladder, rounded, total


@dataclass(frozen=True)
class HumanMarks:
    """Words of thought and of doubt, and patterns of the first and third person and of an all-knowing teller."""

    thoughts: tuple[str, ...]
    doubts: tuple[str, ...]
    first: str
    third: str
    leaks: str


# Phrases and marks of the domain's script.
TICS = tuple(
    """不由得 不禁 下意识 心中一凛 眼中闪过 嘴角微微上扬 深吸一口气 瞳孔微缩 心头一颤 浑身一震 倒吸一口凉气 目光一凝 脸色一变
    心中一动 不自觉地 脑海中闪过 心底涌起 眼神一暗 眸色一沉 心中一紧 心头一紧 微微一愣 愣了愣 怔了怔 顿了顿 冷哼一声 微微皱眉 眉头一皱
    眉头微蹙 若有所思 沉吟片刻 沉默片刻 沉默了一下 缓缓开口 淡淡道 冷冷道 低声说道 语气中带着 眼中闪过一丝 嘴角勾起一抹 露出一抹 浮现一抹
    带着几分 不可否认 显而易见 值得注意的是 在某种程度上 某种意义上 总的来说 不仅如此 与此同时 换句话说 究其原因 归根结底 从某种程度上说""".split()
)
ZH = HumanMarks(
    thoughts=tuple(
        """我觉得 我感到 我感觉 我心里 我心中 我内心 我意识到 我突然想到 我忽然明白 我明白 我懂了 我不确定 我犹豫 我纠结 我挣扎 我害怕 我担心
        我期待 我渴望 我恨 我厌 莫名其妙地 不知道为什么 鬼使神差 忍不住 下意识地 不自觉地 恍惚间 一瞬间 脑海中闪过 心底涌起 心头一紧 心一横 深吸一口气
        咬了咬牙 握紧拳头 眼眶发热""".split()
    ),
    doubts=tuple("但是 可是 然而 不过 虽然 尽管 犹豫 纠结 挣扎 矛盾 两难 一方面 另一方面 既想 又怕 理智告诉我 但心里 明明知道 却还是 说不上来 说不清 无法形容 复杂".split()),
    first=r"(?:^|[。！？…；\s　])我",
    third=r"(?:^|[。！？…；\s　])(?:他|她)",
    leaks="(?:殊不知|他不知道的是|她不知道的是|而此刻|不远处|隔壁|千里之外|另一边|暗处|暗中|背地里|私下里|此刻.{0,5}正|此时.{0,5}正|这时候.{0,5}正|就在这时)|(?:他|她)(?:暗自|偷偷|悄悄|默默|暗暗)",
)


def each_count(text: Column, words: Sequence[str]) -> list[Column]:
    """How often each word stands in a text; words may overlap each other."""
    return [((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("long") for w in words]


def tic_density(texts: DataFrame, key: str = "doc_id", text: str = "text", phrases: Sequence[str] = TICS) -> DataFrame:
    """(key, n_tics, n_phrases, density, score): stock phrases by 1000 letters, 100 for few of them. Texts of fewer than 100 letters count as clean."""
    base = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = base.select(key, F.length(dense(F.col("t"))).alias("chars"), F.array(*each_count(F.col("t"), phrases)).alias("n"))
    long = F.col("chars") >= 100
    all_ = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    each = n.select(key, F.when(long, all_).otherwise(0).cast("long").alias("n_tics"), F.when(long, F.size(F.filter("n", lambda x: x > 0))).otherwise(0).cast("long").alias("n_phrases"), "chars")
    each = each.withColumn("density", F.when(F.col("chars") >= 100, rounded(F.round(F.col("n_tics") / (F.col("chars") / 1000), 9), 2)).otherwise(0.0))
    d = F.col("density")
    return each.select(key, "n_tics", "n_phrases", "density", F.when(d <= 0.3, 100).when(d <= 0.5, 90).when(d <= 1, 70).when(d <= 2, 40).otherwise(15).alias("score"))


def human_likeness(texts: DataFrame, key: str = "doc_id", text: str = "text", marks: HumanMarks = ZH) -> DataFrame:
    """(key, perspective, consistency, thought_density, n_doubts, n_leaks, score): perspective, thoughts, doubts and leaks of an all-knowing teller, and points up to 100. Texts of fewer than 50 letters have 50."""
    c, t = F.col, F.col("t")
    base = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = base.select(key, F.length(dense(t)).alias("chars"), F.regexp_count(t, F.lit(marks.first)).alias("a"), F.regexp_count(t, F.lit(marks.third)).alias("b"), total(each_count(t, marks.thoughts)).alias("thoughts"), total(each_count(t, marks.doubts)).alias("doubts"), F.regexp_count(t, F.lit(marks.leaks)).alias("leaks"))
    long, both = c("chars") >= 50, c("a") + c("b")
    pov = ladder((~long | (both == 0), "unknown"), (c("a") > 2 * c("b"), "first"), (c("b") > 2 * c("a"), "third"), otherwise="mixed")
    part = ladder((c("a") > 2 * c("b"), "a"), (c("b") > 2 * c("a"), "b"), otherwise="d")
    share = F.when(part == "a", c("a")).when(part == "b", c("b")).otherwise(F.abs(c("a") - c("b")))
    each = n.select(
        key, pov.alias("perspective"), F.when(pov == "unknown", 0).otherwise(F.floor(F.round(100 * share / F.greatest(both, F.lit(1)), 9))).cast("long").alias("consistency"),
        F.when(long, rounded(F.round(c("thoughts") / (c("chars") / 1000), 9), 2)).otherwise(0.0).alias("thought_density"), F.when(long, c("doubts")).otherwise(0).cast("long").alias("n_doubts"), F.when(long, c("leaks")).otherwise(0).cast("long").alias("n_leaks"), long.alias("long"),
    )
    p, d = c("perspective"), c("thought_density")
    score = 50 + F.when(p == "first", 25).when(p == "third", 5).otherwise(0) + F.when(c("consistency") >= 80, 5).when(c("consistency") >= 60, 3).otherwise(0)
    score = score + F.when((d >= 1) & (d <= 3), 25).when((d >= 0.5) & (d < 1), 15).when(d > 3, 5).otherwise(0) + F.when(c("n_doubts") >= 3, 15).when(c("n_doubts") >= 1, 8).otherwise(0)
    score = score + F.when(c("n_leaks") == 0, 5).when(c("n_leaks") > 2, -3 * (c("n_leaks") - 2)).otherwise(0)
    return each.select(key, "perspective", "consistency", "thought_density", "n_doubts", "n_leaks", F.when(c("long"), F.greatest(F.lit(0), F.least(F.lit(100), score))).otherwise(50).cast("int").alias("score"))
