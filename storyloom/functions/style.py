"""Markers of style as data, for the script of the domain and for the Latin-script sample tables."""

from __future__ import annotations

from typing import NamedTuple


class StylePack(NamedTuple):
    letters: str
    ends: str
    dialogue: str
    description: str  # how a describing paragraph begins
    idiom: str
    slang: str
    fingerprints: tuple[str, ...]  # words that betray a machine
    doubled: str
    scene: str
    irony: str
    self_mockery: str
    dark: str
    first: str
    third: str
    monologue: str
    omniscient: str
    lower: bool = False


# Markers of the domain.
ZH_STYLE = StylePack(
    letters=r"[\x{4e00}-\x{9fff}]",
    ends="。！？；…!?",
    dialogue='["“”「」『』].*?["“”「」『』]',
    description="^(?:天|阳光|月光|风|雨|雪|山|河|城|街道|房间|空气中|清晨|黄昏|夜晚|春天|夏天|秋天|冬天|太阳|月亮|星星|云|远处|近处|四周|周围|眼前|身后|头顶|脚下|花|树|草|石|水|火|光|影|声|色|香|味)",
    idiom=r"[\x{4e00}-\x{9fff}]{4}(?:道|说|想|看|笑|走|跑|站|坐|来|去|了|着|过|的|地|得)|[\x{4e00}-\x{9fff}]{2}(?:如也|不已|不得|不堪|不言|不语|无常|无力|有声|有色|有味)",
    slang="卧槽|我靠|我擦|牛逼|屌爆|666|233|哈哈哈|呵呵|嘻嘻|艾玛|我去|泪目|破防|绝绝子|yyds|awsl|xswl|emo|破大防|栓Q|芭比Q|裂开|蚌埠住|赢麻了|杀疯了|好家伙|我的天|妈耶|老天爷|我的老天",
    fingerprints=("不由地", "不由得", "下意识地", "不禁", "旋即", "方才", "此刻", "极为", "极其", "无比", "异常", "惊人地", "深吸一口气", "眼中闪过一抹", "嘴角微微上扬", "握紧了拳头", "目光扫过", "随手一挥", "化为齑粉", "化为虚无", "此外", "总而言之", "综上所述", "值得注意的是", "不可否认", "与此同时", "另一方面", "显而易见", "由此可见", "事实上", "从而", "进而", "首先", "其次"),
    doubled=r"([\x{4e00}-\x{9fff}])\1",
    scene=r"与此同时|另一边|另一处|此时|就在这时|就在此时|不多时|过了一会|片刻后|半晌后|须臾|霎时|※|---|\*\*\*|～～",
    irony="呵呵|可不是嘛|说得轻巧|想得美|美得你|做梦|想多了|好一个|好一句|真是好样的|真行|真了不起|鬼才信|谁信啊|骗鬼呢|说得跟真的似的|呵呵呵|呵|嗤|哼|切",
    self_mockery="自嘲|苦笑|无奈|摇头苦笑|苦涩|心酸|自己就是个|自己不过是|自己算什么|可笑|可悲|可叹|何苦|何必|谁让自己|怪只怪|只怪自己",
    dark="黑色幽默|地狱笑话|细思极恐|死了一样|比死还难受|生不如死|这都不死|主角光环|命硬|阎王爷|黑白无常|奈何桥|笑死人|笑掉大牙|笑死|乐死",
    first="我|我的|我们",
    third="他|她|它",
    monologue="心想|暗想|寻思|琢磨|心想道|心中想|脑海[中里]?闪过|脑海中浮现|我不禁想|他不禁想|她不禁想|我在想|他在想|她在想|内心深处|心底|心中|潜意识|直觉告诉",
    omniscient="殊不知|他不知道的是|她不知道的是|此刻的[他她]还不知道|远在千里之外|与此同时.*?却|如果[他她]知道|假若[他她]知道|命运的齿轮|冥冥之中|天意",
)

# Words and syllables of the sample tables.
LATIN_STYLE = StylePack(
    letters="[a-zà-ÿ]",
    ends=".!?…",
    dialogue='"[^"\\n]*"',
    description="^(?:th|an|in|he|er|le|la|die|der)",
    idiom="tion|ment",
    slang="haha|lol|ouou",
    fingerprints=("that", "which", "whth", "dass", "donc", "ingly"),
    doubled="|".join(2 * chr(c) for c in range(ord("a"), ord("z") + 1)),
    scene="then|puis|dann",
    irony="sure|bien|ja ",
    self_mockery="sorry|onre",
    dark="dead|mort|tot",
    first="i |me|je|ich",
    third="he|she|il|er",
    monologue="think|that|dass",
    omniscient="fate|ores",
    lower=True,
)

# Fixed values: (dimension, metric, weight, percent that warns, percent that is serious).
COMPARED = (
    ("syntax", "avg_sentence_length", 0.25, 20, 40),
    ("syntax", "dialogue_ratio", 0.20, 25, 50),
    ("syntax", "description_density", 0.15, 30, 60),
    ("syntax", "short_sentence_ratio", 0.15, 25, 50),
    ("syntax", "sentence_length_std", 0.10, 30, 60),
    ("vocabulary", "fingerprint_density", 0.30, 50, 200),
    ("vocabulary", "vocab_richness", 0.25, 15, 30),
    ("vocabulary", "idiom_density", 0.20, 40, 80),
    ("vocabulary", "slang_density", 0.15, 50, 100),
    ("vocabulary", "doubled_density", 0.10, 40, 80),
    ("rhythm", "avg_paragraph_length", 0.30, 25, 50),
    ("rhythm", "scene_density", 0.25, 30, 60),
    ("rhythm", "paragraph_length_std", 0.20, 30, 60),
    ("rhythm", "short_sentence_ratio", 0.25, 25, 50),
    ("humour", "humour_total", 0.50, 50, 100),
    ("humour", "irony_density", 0.20, 50, 100),
    ("humour", "self_mockery_density", 0.20, 50, 100),
    ("humour", "dark_density", 0.10, 50, 100),
    ("perspective", "monologue_density", 0.30, 40, 80),
    ("perspective", "first_person_ratio", 0.25, 20, 40),
    ("perspective", "omniscient_density", 0.25, 40, 80),
    ("perspective", "dialogue_ratio", 0.20, 25, 50),
)


class FlavourPack(NamedTuple):
    """Markers of machine prose: phrases not to be used, and what living prose has."""

    letters: str
    banned_transitions: tuple[str, ...]
    banned_descriptions: tuple[str, ...]
    mistakes: str
    preaching: str
    line: str
    particles: str
    connectives: str
    sensory: str
    direct_emotion: str
    life: str
    ends: str
    lower: bool = False


# Markers of the sample tables.
LATIN_FLAVOUR = FlavourPack("[a-zà-ÿ]", ("which", "donc"), ("ouou", "thth"), "not|nicht|pas", "that|dass", '"([^"\\n]+)"', "oh|ah|eh", "but|mais|aber", "inth|ores|here", "love|heart|onre", "with|avec|mit", ".!?", True)
# Markers of the domain.
ZH_FLAVOUR = FlavourPack(
    r"[\x{4e00}-\x{9fff}]",
    ("此外", "总而言之", "综上所述", "值得注意的是"),
    ("眼中闪过一抹", "嘴角微微上扬"),
    "失误|犯错|搞砸|失手|判断错误|后悔|愧疚|自责|犹豫|迟疑|踌躇|拿不定主意|左右为难|进退两难|弱点|软肋|心魔|阴影|不堪|窝囊|狼狈",
    "人生[就才是]|你[必须应该要]明白|道理|真理|真谛|本质|意义|价值|从来[都没]有|永远[都不]会|归根结底|说到底",
    '[「"“]([^」"”]+)[」"”]',
    "啊|吧|呢|吗|嘛|呀|哦|嗯|哎|喂|哈|嘿",
    "因为|所以|因此|然而|但是|不过|虽然|如果|那么|总之",
    "闻到|气味|味道|香气|臭味|腥味|刺鼻|浓烈|淡淡|触摸|碰到|冰凉|滚烫|粗糙|光滑|柔软|坚硬|湿润|干燥|听见|声音|响声|轰鸣|低语|沙沙|咔嚓|砰|啪|嗖|看到|瞥见|映入|浮现在|闪烁|昏暗|明亮|刺眼|模糊",
    "心痛|心碎|悲伤|难过|痛苦|绝望|崩溃|愤怒|暴怒|大怒|狂怒|愤恨|激动|兴奋|狂喜|欣喜|雀跃|感动|流泪|泪流满面|热泪盈眶|泣不成声",
    "吃饭|做饭|买菜|逛街|散步|喝茶|喝咖啡|喝酒|聊天|闲聊|八卦|吐槽|开玩笑|打趣|睡觉|起床|洗漱|换衣服|照镜子|发呆|走神|心不在焉|无所事事|无所适从",
    "。！？；",
)
