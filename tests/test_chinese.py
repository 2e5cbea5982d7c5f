"""The domain's own script: chapters, counts and rules on small Chinese texts, against values worked out by hand or in loops."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from storyloom.functions.columns import chinese_number
from storyloom.functions.lexicon import RICH_ZH, ZH
from storyloom.functions.style import ZH_FLAVOUR, ZH_STYLE
from storyloom.operators import detectors, sequence, story, style, text
from storyloom.operators.projection import chapter_counts, chapter_metrics, rich_scan


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(("numeral", "value"), [("一", 1), ("十", 10), ("十二", 12), ("二十", 20), ("一百二十三", 123), ("一千零五", 1005), ("两百", 200), ("15", 15), ("007", 7), ("零", 1), ("", 0)])
def test_numerals(spark, numeral, value):
    assert frame(spark, [(numeral,)], "x string").select(chinese_number(F.col("x"))).first()[0] == value


SENTENCE = "少年站在山门之前，望着远处的群山，心里想着今天的比试。"


def chapters(spark, book, **kw):
    return [tuple(r) for r in text.extract_chapters(frame(spark, [("b", book)], "book string, text string"), **kw).orderBy("place").select("num", "title").collect()]


def test_three_chapters(spark):
    book = f"第一章 开始\n{SENTENCE * 3}\n\n第二章 发展\n{SENTENCE * 3}\n\n第三章 结束\n{SENTENCE * 3}"
    got = text.extract_chapters(frame(spark, [("b", book)], "book string, text string")).orderBy("place").collect()
    assert [(r.num, r.title) for r in got] == [(1, "第一章 开始"), (2, "第二章 发展"), (3, "第三章 结束")]
    assert all(not re.search("第.章", r.body) and r.wc == len(SENTENCE) * 3 and r.para_count == 1 for r in got)


def test_other_headers(spark):
    assert chapters(spark, f"序章 起\n{SENTENCE * 3}\n章二 承\n{SENTENCE * 3}\n") == [(1, "序章 起"), (2, "章二 承")]
    assert chapters(spark, f"12 山门\n{SENTENCE * 3}\n13 比试\n{SENTENCE * 3}\n") == [(12, "12 山门"), (13, "13 比试")]
    bare = f"1\n{SENTENCE * 3}\n1999\n{SENTENCE * 3}\n2\n{SENTENCE * 3}\n3\n短\n"
    assert chapters(spark, bare + f"4\n{SENTENCE * 3}") == [(1, "1"), (2, "2"), (4, "4")]
    assert chapters(spark, SENTENCE) == [] and chapters(spark, f"第一章 独\n{SENTENCE * 4}") == []
    assert chapters(spark, SENTENCE * 3, headers=text.LOOSE, least=(1,), whole=True) == [(1, "")]
    assert chapters(spark, f"第一章 短\n太短了\n第二章 长\n{SENTENCE * 3}") == [(2, "第二章 长")]


BODY = "他冷笑一声：“就这？你也配！”众人惊呆了，鸦雀无声。\n\n他轻声说：我会守护大家，绝境之中突破，反杀强敌！\n\n远处的守护塔静静矗立在没有人的荒原上面已经过去了很多很多年了没有谁来过这里也没有谁离开这里。\n\n难道，这就是真相？"


def by_loops(body):
    """Counts of the classes by Python's own regular expressions, and what follows from them."""
    out = {n: len(re.findall(e.pattern, body)) for n, e in ZH.pleasure.items() if n != "bond"}
    words = "为你|替我|并肩|一起|等我|别走|回来|留下|陪你|跟你|我会保护|我答应|不放手|伸出手|碰了碰|贴着|靠着|第一[个次位]|唯一|只有你|只要你|除了你|不会让|不许|不行|不准|羁绊|守护"
    out["bond"] = sum(bool(re.search("你|我|他|她|眼中|心里|轻声|沉默|握住|凝视", body[max(0, m.start() - 30) : m.end() + 30])) for m in re.finditer(words, body))
    return out


def test_projection_of_a_chapter(spark):
    books = frame(spark, [(1, BODY, "b"), (2, None, "b"), (3, "", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in chapter_metrics(chapter_counts(books, ZH), ZH).collect()}
    r, want = got[1], by_loops(BODY)
    assert {n: r[f"{n}_count"] for n in want} == want and want["bond"] == 2 and want["slap"] == 5
    wc = len(BODY.replace("\n", "").replace(" ", ""))
    assert r.wc == wc and r.para_count == 4 and r.dominant_sub == "打脸" and r.pleasure_timing == "instant"
    weighted = sum(want[n] * e.weight for n, e in ZH.pleasure.items()) + len(re.findall(ZH.general.pattern, BODY)) * ZH.general.weight + len(re.findall(ZH.physio.pattern, BODY)) * ZH.physio.weight
    assert abs(r.pos_density - weighted / wc * 100) < 0.006
    assert abs(r.conflict_density - sum(len(re.findall(p, BODY)) for p in ZH.conflict.values()) / wc * 100) < 0.006
    assert abs(r.dialogue_ratio - sum(len(m.group()) for m in re.finditer(ZH.dialogue, BODY)) / wc) < 0.0006
    sentences = [s.strip() for s in re.split("[。！？!?]", BODY) if s.strip()]
    assert abs(r.avg_sentence_len - sum(map(len, sentences)) / len(sentences)) < 0.06
    assert r.hook_type == "疑问式" and r.emotion_valence == 3 * r.high_emotion_count - 2 * len(re.findall(ZH.low_emotion, BODY)) - 4 * r.burnout_count + 2 * r.physio_count
    assert got[2].wc == got[3].wc == 0 and got[2].hook_type == "none" and got[2].dominant_sub == "打脸"


@pytest.mark.parametrize(("near", "n"), [("", 0), ("他", 1), ("她" + "山" * 29, 1), ("她" + "山" * 30, 0)])
def test_bond_in_its_context(spark, near, n):
    """A word of bonds counts within thirty characters of a pronoun, before or after it."""
    rows = [(1, "山" * 40 + near + "守护" + "水" * 40, "b"), (2, "水" * 40 + "守护" + near[::-1] + "山" * 40, "b")]
    got = chapter_counts(frame(spark, rows, "doc_id long, text string, source string"), ZH).collect()
    assert [r.bond_count for r in got] == [n, n] == [by_loops(t)["bond"] for _, t, _ in rows]


@pytest.mark.parametrize(
    ("ending", "kind"),
    [("没想到竟然是他。", "悬念式"), ("他再也不会回到那个地方", "情绪炸弹"), ("少年的眼前面板上慢慢浮现出一行新的文字", "信息投放"), ("少年抬起头望见前面就是毁灭的深渊了", "威胁式"), ("你是谁？", "疑问式"), ("少年对着她说我们改日在城门口再见面吧", "承诺式"), ("叮！得到一把钥匙。", "系统提示"), ("天黑了。", "none")],
)
def test_hook_types(spark, ending, kind):
    body = f"{SENTENCE}\n{ending}"
    books = frame(spark, [(1, body, "b")], "doc_id long, text string, source string")
    assert chapter_metrics(chapter_counts(books, ZH), ZH).first().hook_type == kind


def test_rich_scan(spark):
    docs = frame(spark, [(1, BODY)], "doc_id long, text string")
    r = rich_scan(docs, RICH_ZH, dialogue=ZH.dialogue, ends="。！？!?", lower=False).first()
    letters = len(re.findall("[一-鿿]", BODY))
    assert r.chars == letters
    assert abs(r.hook_density - sum(len(re.findall(p, BODY)) for p in RICH_ZH["hook"].values())) < 0.006
    assert abs(r.conflict_density - 100 * sum(len(re.findall(p, BODY)) for p in RICH_ZH["conflict"].values()) / letters) < 0.006


def arc(spark, states):
    return frame(spark, [("林", i + 1, s, None) for i, s in enumerate(states)], "character string, ch_num long, emotion string, growth string")


def test_emotion_monotony(spark):
    three = sequence.repeats(arc(spark, ["怒", "怒", "怒"]), "emotion", "character", ["ch_num"]).collect()
    assert [(r.ch_num, r.run) for r in three] == [(3, 3)]
    assert sequence.changes(arc(spark, ["怒", "怒", "怒", "喜"]), "emotion", "character", ["ch_num"]).first()[1:] == (1, 2)
    assert sequence.repeats(arc(spark, ["怒", None, "怒", "怒", "喜"]), "emotion", "character", ["ch_num"]).count() == 1


def test_growth_stagnation(spark):
    rows = arc(spark, ["怒"] * 10)
    assert sequence.stagnation(rows, F.col("growth").isNotNull(), "character", ["ch_num"]).count() == 1
    assert sequence.stagnation(rows.withColumn("growth", F.when(F.col("ch_num") == 5, "悟")), F.col("growth").isNotNull(), "character", ["ch_num"]).count() == 0


def test_emotion_scores(spark):
    words = {"绝望": 1, "害怕极了": 2, "心碎": 3, "疲惫": 4, "犹豫": 5, "平静": 6, "震惊": 7, "怒火": 7, "决心": 8, "狂喜": 9, "热血沸腾": 10, "茫然": 5}
    got = frame(spark, [(w,) for w in words], "w string").select("w", sequence.emotion_score(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == words


def test_phases_against_a_loop(spark):
    rows = [("b", i + 1, float((i * 7) % 11) / 2, "fast" if i % 5 else "slow", "打脸" if i % 9 < 6 else "突破") for i in range(40)]
    want, start, sub = [], 1, rows[0][4]
    for i in range(1, len(rows)):
        gap = round(abs(rows[i][2] - rows[i - 1][2]), 6)
        if gap > 3 or (rows[i][3] != rows[i - 1][3] and gap > 1.5) or (rows[i][4] != sub and i - start > 5):
            want.append((start, i, sub))
            start, sub = i + 1, rows[i][4]
    want.append((start, len(rows), sub))
    got = sequence.phases(frame(spark, rows, "book string, ch_num long, pleasure_intensity double, pace string, dominant_sub string")).orderBy("phase").collect()
    assert [(r.start_ch, r.end_ch, r.dominant_sub) for r in got] == want


def test_foreshadows(spark):
    events = frame(spark, [(1, 1, "hook", 9, None), (2, 3, "plot", 6, 1), (3, 4, "plot", 5, 1), (4, 2, "hook", 3, None), (5, 9, "plot", 8, None), (6, 5, "hook", 2, None)], "event_id long, chapter_id long, event_type string, importance long, related_id long")
    links = frame(spark, [("a", 1, 1, 9), ("a", 2, 3, 6), ("a", 3, 4, 5), ("b", 4, 2, 3), ("b", 5, 9, 8)], "entity string, event_id long, chapter_id long, importance long")
    got = {r.event_id: (r.status, r.resolver_chapter, r.since) for r in story.foreshadow_status(events, links, "hook").collect()}
    assert got == {1: ("resolved", 3, 2), 4: ("active", None, 7), 6: ("active", None, 0)}


def test_lifecycle(spark):
    rows = frame(spark, [("林", 1, "active"), ("林", 2, None), ("林", 3, "dead"), ("林", 4, "active"), ("苏", 1, "dormant"), ("苏", 2, "active")], "who string, ch long, state string")
    got = story.lifecycle_violations(rows, F.col("state"), "who", ["ch"]).collect()
    assert [(r.who, r.ch, r.before, r.status) for r in got] == [("林", 4, "dead", "active")]


def test_red_lines(spark):
    lines = (detectors.Line("kneel", "character", "critical", ("跪倒在地", "求饶")), detectors.Line("jump", "plot", "warning", patterns=("突然.{0,5}来到了",)))
    docs = frame(spark, [(1, "他跪倒在地，求饶不止，又求饶。"), (2, "突然他来到了城里"), (3, "平静"), (4, None)], "doc_id long, text string")
    got = [(r.doc_id, r.rule, r.matched, r.position) for r in detectors.red_lines(docs, lines).orderBy("doc_id", "position").collect()]
    assert got == [(1, "kneel", "跪倒在地", 1), (1, "kneel", "求饶", 6), (1, "kneel", "求饶", 12), (2, "jump", "突然他来到了", 0)]
    allowed = frame(spark, [(1, "kneel")], "doc_id long, rule string")
    assert {r.doc_id for r in detectors.red_lines(docs, lines, allowed=allowed).collect()} == {2}
    assert detectors.red_lines(docs, lines, categories=["plot"]).count() == 1


def test_style_inequalities(spark):
    talk = "「你来了？」「我来了。」「走吧。」他点头。「好！」「我们出发。」" * 6
    scenery = "阳光洒满山谷，云在远处飘荡。\n\n风吹过树林，叶子沙沙作响。\n\n" * 8
    first = "我走进房间。我看着窗外，我想起了往事，我心里很难过。" * 8
    machine = "他不禁深吸一口气，旋即目光扫过众人，此刻极为安静。" * 8
    docs = frame(spark, list(enumerate([talk, scenery, first, machine, "太短"])), "doc_id long, text string")
    r = {x.doc_id: x for x in style.style_dna(docs, ZH_STYLE).collect()}
    assert r[0].dialogue_ratio > 0.3 and r[1].description_density > 0.5 and r[1].paragraph_count == 16
    assert r[2].perspective == "first" and r[3].fingerprint_density > 2 and r[4].sentence_count == 0
    scores = {x.doc_id: x for x in style.human_flavour(docs, ZH_FLAVOUR).collect()}
    assert scores[0].naturalness > scores[3].naturalness == 0


def test_ngrams_against_a_counter(spark):
    t = "山门之前，山门之后，山门之前。"
    runs = re.findall("[一-鿿]+", t)
    want = collections.Counter(w[i : i + n] for w in runs for n in (2, 3, 4) for i in range(len(w) - n + 1))
    got = style.top_ngrams(frame(spark, [(1, t)], "doc_id long, text string"), letters=r"[\x{4e00}-\x{9fff}]", lower=False).collect()
    assert {r.gram: r.n for r in got} == {g: n for g, n in want.items() if n >= 2}


def test_encodings(spark):
    t = "山门之前，abc。"
    raw = [(1, t.encode()), (2, t.encode("gbk")), (3, b"\xff\xfe" + t.encode("utf-16-le")), (4, b"\xef\xbb\xbf" + t.encode()), (5, b""), (6, None)]
    got = {r.i: r for r in frame(spark, [(i, None if b is None else bytearray(b)) for i, b in raw], "i long, content binary").select("i", text.encoding(F.col("content")).alias("mark"), text.decoded("content").alias("d")).collect()}
    assert all(got[i].d.text == t for i in (1, 2, 3, 4)) and got[5].d.text == "" and got[6].d.text is None
    assert (got[1].mark, got[2].mark, got[3].mark, got[4].mark) == ("utf-8", None, "utf-16-le", "utf-8-sig")


def test_genre(spark):
    lexicon = {"末世": {"丧尸": 1.0, "异能": 0.5}, "玄幻": {"修炼": 1.0, "灵气": 1.0}}
    docs = frame(spark, [(1, "x", "丧尸来了，丧尸走了，异能觉醒，丧尸！"), (2, "x", "plain English text"), (3, "玄幻之路", "丧尸丧尸丧尸"), (4, "x", "丧尸丧尸修炼灵气")], "doc_id long, name string, text string")
    got = {r.doc_id: (r.genre, r.method) for r in text.detect_genre(docs, lexicon, {"玄幻": "玄幻"}).collect()}
    assert got == {1: ("末世", "keywords"), 2: ("unknown", "unknown"), 3: ("玄幻", "title"), 4: ("unknown", "keywords")}


def test_basic_filter(spark):
    good = "\n".join(f"第{i}章 山门\n{SENTENCE * 40}" for i in range(1, 90))
    docs = frame(spark, [(1, "a", "太短"), (2, "b", good), (3, "名著", "短")], "doc_id long, name string, text string")
    got = {r.doc_id: (r.passed, r.reason) for r in text.basic_filter(docs, ["名著"]).collect()}
    assert got[1] == (False, "too_small") and got[3] == (True, "known") and got[2][1] in ("ok", "odd_chapters", "few_chapters")
