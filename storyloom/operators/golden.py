"""The first three chapters of a book in five dimensions, and how far they are from a benchmark.

G1 hook of the opening, G2 clearness of the protagonist, G3 core conflict, G4 density of foreshadowing, G5 curve of emotions. Marks are counted
where the chapters are read; only counts are shuffled. The protagonist's name, taken from the first chapter unless a canon gives it, is counted in each chapter
by itself, so that a name does not arise where two chapters meet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.columns import ladder, rounded, total


@dataclass(frozen=True)
class GoldenMarks:
    """Alternatives of regular expressions, and the letters that count as length."""

    letters: str
    conflict: str
    suspense: str
    danger: str
    anomaly: str
    scenery: str
    person: str
    info: str
    goal: str
    flaw: str
    want: str
    obstacle: str
    confront: str
    foreshadow: str
    hint: str
    high: str
    mid: str
    low: str
    positive: str
    speaker: str


# Marks of the domain's script.
ZH = GoldenMarks(
    letters="[一-鿿]",
    conflict="战斗|厮杀|搏杀|血战|激战|大战|对决|决斗|杀意|杀气|杀机|出手|进攻|攻击|反击|偷袭|暗算|围杀|拼命|拼死|搏命|殊死|生死|致命|你敢|休想|去死|找死|不可能！|我不信|凭什么",
    suspense="究竟|到底|为什么|怎么会|难道|莫非|谁|什么|答案|秘密|未知|诡异|奇怪|异常|不对劲|不可能|匪夷所思|忽然|突然|骤然|猛然|赫然|不料|竟然|居然",
    danger="危险|危机|威胁|陷阱|包围|逼近|来袭|逃|躲|追|困|陷|围|困住|困在",
    anomaly="反常|异变|变异|异象|异常|不寻常|前所未有|黑色|血红|诡异|恐怖|阴森|不详",
    scenery="天|阳光|月光|风|雨|雪|山|河|城|街道|房间|空气中|清晨|黄昏|夜晚|春天|夏天|秋天|冬天|太阳|月亮|星星|云",
    person="他|她|它|我|那|这",
    info="发现|揭示|得知|明白|意识到|原来|真相|秘密|新|突然|意外|浮现|显示|弹出|解锁|觉醒",
    goal="想要|需要|必须|一定要|决心|发誓|目标|梦想|渴望|为了|想要得到|追求|争取|夺|抢|找回|保护|守护|复仇|报仇|变强|成为|超越|征服|统一|称霸|证道|飞升",
    flaw="失误|犯错|搞砸|失手|判断错误|后悔|愧疚|自责|犹豫|迟疑|弱点|软肋|心魔|缺陷|不足|短处|盲目|冲动|懦弱|胆小|自卑|傲慢|固执|偏执|贪婪|恐惧|害怕",
    want="想要|需要|必须|渴望|追求|想要得到|为了|目标|梦想|野心|欲望|企图",
    obstacle="但是|可是|然而|不过|却|偏偏|无奈|只是|可惜|阻碍|障碍|困难|敌人|对手|限制|约束|不可能|无法|不能|阻止|阻止不了|挡|拦|封锁|围剿|追杀",
    confront="对抗|对决|较量|交手|冲突|矛盾|争斗|反击|反抗|挣扎|突破|打破|冲破",
    foreshadow="伏笔|暗示|线索|疑点|谜团|悬念|疑问|不知|不明|神秘|奇怪|诡异|未解|仿佛|似乎|好像|隐约|若有若无|原来如此|终于明白|真相大白|谜底揭晓",
    hint="不[寻正]常|不对劲|有问题|蹊跷|古怪|意味深长|若有所思|欲言又止|深邃的|埋下|埋了|暗藏|暗含|暗指|影射",
    high="愤怒|暴怒|狂怒|震怒|怒火|激怒|狂喜|狂笑|兴奋|激动|振奋|热血沸腾|恐惧|惊恐|骇然|胆寒|毛骨悚然|绝望|崩溃|歇斯底里|疯狂|癫狂|震惊|震撼|不可思议|难以置信|战斗|厮杀|搏杀|血战|拼命|殊死",
    mid="紧张|焦虑|不安|担忧|忧虑|忐忑|期待|希望|渴望|向往|疑惑|困惑|迷茫|不解|惊讶|意外|愣|怔|呆",
    low="平静|淡然|释然|坦然|从容|平和|波澜不惊|心如止水|麻木|冷漠|漠然|空洞|认命|疲惫|乏力|无力|叹息|沉重",
    positive="开心|快乐|幸福|满足|欣慰|温暖|笑|微笑|大笑|苦笑|感动|感恩|感激|感谢|信任|信赖|安心|放心",
    speaker="([一-鿿]{2,4})(?:说|道|想|看|笑|走|跑|站|坐)",
)
# Weights of the dimensions, their pass marks, and the steps of the grade.
WEIGHTS = {"g1": 0.25, "g2": 0.2, "g3": 0.25, "g4": 0.15, "g5": 0.15}
PASS = {"g1": 6.0, "g2": 6.0, "g3": 6.0, "g4": 5.0, "g5": 6.0}
GRADES = ((9, "S"), (8, "A"), (7, "B"), (6, "C"), (4, "D"))
CANON = {"protagonist": "string", "arc_words": "array<string>", "conflict_words": "array<string>", "early_foreshadows": "int", "golden_hooks": "int"}


def _clamped(x: Column) -> Column:
    return rounded(F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), x)), 9), 1)


def _steps(x: Column, *steps: tuple[float, float], below: tuple[float, float] | None = None) -> Column:
    """The points of the first bound that x reaches; `below`: points under a bound."""
    out = F.when(x >= steps[0][0], F.lit(float(steps[0][1])))
    for bound, points in steps[1:]:
        out = out.when(x >= bound, F.lit(float(points)))
    return (out.when(x < below[0], F.lit(float(below[1]))) if below else out).otherwise(F.lit(0.0))


def speaker(opening: Column, pattern: str) -> Column:
    """The name before a word of speech or movement that stands most often in a text, the first of equal ones."""
    names = F.regexp_extract_all(opening, F.lit(pattern), 1)
    ranked = F.transform(names, lambda x, i: F.struct((-F.size(F.filter(names, lambda y: y == x))).alias("n"), i.alias("i"), x.alias("name")))
    return F.array_min(ranked)["name"]


def golden_three(chapters: DataFrame, marks: GoldenMarks = ZH, by: str = "book", number: str = "ch_num", text: str = "text", canon: DataFrame | None = None) -> DataFrame:
    """(by, g1 .. g5, passed, total, grade) of a book's first three chapters. canon: (by, and columns of CANON), a row a book."""
    n_of = lambda x, p: F.regexp_count(x, F.lit(p))
    t, c, m = F.coalesce(F.col(text), F.lit("")), F.col, marks
    first = chapters.where(c(number).between(1, 3)).select(by, c(number).alias("num"), t.alias("t"))
    known = canon if canon is not None else first.select(by).distinct()
    known = known.select(by, *[c(x) if x in known.columns else F.lit(None).cast(kind).alias(x) for x, kind in CANON.items()])
    told = first.where("num = 1").select(by, speaker(F.left("t", F.lit(500)), m.speaker).alias("told"))
    named = first.join(known, by, "left").join(told, by, "left").withColumn("name", F.coalesce(F.nullif("protagonist", F.lit("")), "told"))
    head, opening = F.left("t", F.lit(100)), F.left("t", F.lit(500))
    signals = total([n_of(opening, p) for p in (m.conflict, m.suspense, m.danger, m.anomaly)])
    start = F.when(F.rlike(F.left("t", F.lit(10)), F.lit(f"^(?:{m.scenery})")), -2.0).when(F.rlike(F.left("t", F.lit(5)), F.lit(f"^(?:{m.person})")), 0.5).otherwise(0.0)
    counts = named.select(
        by, "num", "name", *CANON, n_of(c("t"), m.letters).alias("cn"),
        total([F.rlike(head, F.lit(p)).cast("int") for p in (m.conflict, m.suspense, m.danger)]).alias("three_seconds"), n_of(opening, m.info).alias("info"), n_of(opening, m.letters).alias("cn500"), signals.alias("signals"), start.alias("start"),
        F.when(F.length("name") > 0, (F.length("t") - F.length(F.replace("t", c("name"), F.lit("")))) / F.length("name")).cast("long").alias("named"),
        *[n_of(c("t"), getattr(m, x)).alias(x) for x in ("goal", "flaw", "want", "obstacle", "confront", "high", "mid", "low", "positive")], (n_of(c("t"), m.foreshadow) + n_of(c("t"), m.hint)).alias("planted"),
        *[F.exists(x, lambda w: F.contains("t", w)).alias(f"has_{x}") for x in ("arc_words", "conflict_words")],
    )
    one = lambda x, k: F.coalesce(F.max(F.when(c("num") == k, c(x))), F.lit(0))
    clash = c("want") + c("obstacle") + c("confront")
    emotion = F.when(c("cn") >= 50, (c("high") + c("mid") + c("low") + c("positive")) / F.greatest(c("cn") / 1000, F.lit(1.0))).otherwise(0.0)
    felt = lambda x: F.when(c("cn") >= 50, c(x)).otherwise(0)
    books = counts.withColumns({"clash": clash, "emotion": F.round(emotion, 2)}).groupBy(by).agg(
        F.sum("cn").alias("cn"), *[one(x, 1).alias(f"first_{x}") for x in ("cn", "three_seconds", "info", "cn500", "signals", "start")], F.max("name").alias("name"), F.sum("named").alias("named"),
        *[F.sum(x).alias(x) for x in ("goal", "flaw", "want", "obstacle", "confront", "planted")], *[one("clash", k).alias(f"clash_{k}") for k in (1, 3)], *[one("emotion", k).alias(f"emotion_{k}") for k in (1, 2, 3)],
        F.max(felt("high")).alias("peak"), total([F.max((felt(x) > 0).cast("int")) for x in ("high", "mid", "low", "positive")]).alias("kinds"),
        *[F.max(x).alias(x) for x in ("has_arc_words", "has_conflict_words", "early_foreshadows", "golden_hooks")],
    )
    info = c("first_info") / F.greatest(c("first_cn500") / 100, F.lit(1.0))
    g1 = 5 + F.when(c("first_three_seconds") >= 2, 3.0).when(c("first_three_seconds") == 1, 1.5).otherwise(0.0) + _steps(info, (1.5, 2), (1, 1), below=(0.3, -1.5)) + c("first_start") + F.when(c("first_signals") >= 5, 1.0).when(c("first_signals") == 0, -1.0).otherwise(0.0)
    arc = F.when(c("has_arc_words"), 0.5).otherwise(0.0)
    g2 = 5 + F.when(c("name").isNull(), -1.0).when(c("named") >= 10, 2.0).when(c("named") >= 5, 1.0).when(c("named") < 2, -1.5).otherwise(0.0) + F.when(c("goal") > 0, 1.5).otherwise(0.0) + F.when(c("flaw") > 0, 1.5).otherwise(0.0) + arc
    want, obstacle = c("want") > 0, c("obstacle") > 0
    g3 = 5 + F.when(want & obstacle, F.when(c("confront") > 0, 3.0).otherwise(2.0)).when(want | obstacle, 0.5).otherwise(-2.0)
    g3 = g3 + F.when(c("clash_3") > c("clash_1"), 1.0).when(c("clash_3") < c("clash_1") * 0.5, -1.0).otherwise(0.0) + F.when(c("has_conflict_words"), 0.5).otherwise(0.0)
    dense = c("planted") / F.greatest(c("cn") / 1000, F.lit(1.0))
    g4 = 5 + _steps(dense, (2, 3), (1, 1.5), below=(0.3, -2)) + F.when(c("planted") >= 4, 1.0).otherwise(0.0) + F.when(c("early_foreshadows") > 0, 1.0).otherwise(0.0) + F.when(c("golden_hooks") >= 3, 0.5).otherwise(0.0)
    mean = F.round((c("emotion_1") + c("emotion_2") + c("emotion_3")) / 3, 9)
    contrast = F.round(F.greatest("emotion_1", "emotion_2", "emotion_3") - F.least("emotion_1", "emotion_2", "emotion_3"), 9)
    g5 = 5 + _steps(mean, (5, 2), (3, 1), below=(1, -2)) + F.when(contrast >= 2, 1.5).when((contrast < 0.5) & (mean < 2), -1.0).otherwise(0.0) + F.when(c("peak") >= 3, 1.5).otherwise(0.0) + F.when(c("kinds") >= 3, 1.0).otherwise(0.0)
    short = c("cn") < 500
    scores = {"g1": F.when(c("first_cn") < 50, 2.0).otherwise(_clamped(g1))} | {g: F.when(short, 3.0).otherwise(_clamped(x)) for g, x in (("g2", g2), ("g3", g3), ("g4", g4), ("g5", g5))}
    rated = books.select(by, *[x.alias(g) for g, x in scores.items()])
    sum_ = rounded(F.round(total([c(g) * w for g, w in WEIGHTS.items()]), 9), 1)
    passed = total([(c(g) >= p).cast("int") for g, p in PASS.items()])
    return rated.withColumns({"passed": passed, "total": sum_}).withColumn("grade", ladder(*[(c("total") >= n, g) for n, g in GRADES], otherwise="F"))


def golden_gaps(scores: DataFrame, benchmark: DataFrame, by: str = "book") -> DataFrame:
    """(by, dimension, author, benchmark, gap, reached): each dimension and the total against a benchmark of one row with the same columns."""
    names = [*WEIGHTS, "total"]
    met = scores.crossJoin(F.broadcast(benchmark.select(*[F.col(g).alias(f"b_{g}") for g in names]).limit(1)))
    pairs = F.array(*[F.struct(F.lit(g).alias("dimension"), F.col(g).alias("author"), F.col(f"b_{g}").alias("benchmark")) for g in names])
    rows = met.select(by, F.explode(pairs).alias("p")).select(by, "p.*").where("benchmark IS NOT NULL")
    return rows.withColumn("gap", rounded(F.round(F.col("author") - F.col("benchmark"), 9), 1)).withColumn("reached", F.col("gap") >= 0)
