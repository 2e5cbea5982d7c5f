"""Lexicons are data: a pack maps each category to a pattern, a weight, a label and a timing."""

from __future__ import annotations

from typing import NamedTuple


class Entry(NamedTuple):
    pattern: str
    weight: float = 1.0
    timing: str = "instant"
    label: str = ""


class Hook(NamedTuple):
    """A hook type by the tail of a text: any of (characters of the tail, pattern)."""

    label: str
    rules: tuple[tuple[int, str], ...]
    #: Also where a short last paragraph follows a long one.
    short_last: bool = False


class LexiconPack(NamedTuple):
    #: Pleasure classes in the order that breaks ties of the dominant class; `general` and `physio` weigh but are never dominant.
    pleasure: dict[str, Entry]
    general: Entry
    physio: Entry
    #: Kinds of conflict, whose counts are summed.
    conflict: dict[str, str]
    negative: str
    hook: str
    anti_trope: str
    high_emotion: str
    low_emotion: str
    burnout: str
    #: Hook types in order of priority.
    hooks: tuple[Hook, ...]
    dialogue: str
    exclamation: str = "[！!？?]"
    #: Characters that end a sentence, inside a character class.
    ends: str = "。！？!?"
    #: Labels of emotions: delight, tension, tragedy, suspense, daily.
    emotions: tuple[str, str, str, str, str] = ("delight", "tension", "tragedy", "suspense", "daily")
    #: Texts are lower-cased before counting.
    lower: bool = False


# Syllables and words of the Latin-script sample tables.
LATIN = LexiconPack(
    pleasure={
        "slap": Entry("ation|stion", 1.5),
        "level": Entry("ering|aire", 1.2),
        "crush": Entry("with|avec", 1.3),
        "comeback": Entry("ther|ment", 1.4, "delayed"),
        "hidden": Entry("from|schung", 1.1, "delayed"),
        "bond": Entry("and|und", 0.8),
        "cognitive": Entry("that|dass", 0.9, "delayed"),
        "sacrifice": Entry("not|nicht", 1.0, "delayed"),
        "strategy": Entry("which|welch", 0.9, "delayed"),
        "resource": Entry("able|ible", 0.7),
        "social": Entry("onti|ción", 0.6),
        "backfire": Entry("whst|wheth", 0.8),
        "trap_master": Entry("ndst|keit", 1.0),
        "knowledge_gap": Entry("heit|ouch", 0.5, "delayed"),
        "hidden_value": Entry("eaux|ó", 0.6, "delayed"),
        "identity_reveal": Entry("ingly|tzu", 1.1),
        "foreshadow_payoff": Entry("inged|queau", 1.0, "delayed"),
    },
    general=Entry("good|bien|gut ", 0.4),
    physio=Entry("blood|ough|herz", 0.5),
    conflict={"combat": "against|war", "psychological": "not|nicht", "moral": "pas", "environment": "erth", "social": "onre", "suspense": "dark|nuit"},
    negative="no |ill|mal|ver|ne ",
    hook="what|who|thes|ieux|ich",
    anti_trope="never|jamais|niemals|nunca",
    high_emotion="love|heart|aime|lieb|ores",
    low_emotion="calm|still|ruhe|lente",
    burnout="tired|weary|müde|las ",
    hooks=(
        Hook("suspense", ((200, "which|whi|quel"),)),
        Hook("emotion", ((250, "love|heart|ores"),)),
        Hook("reversal", ((300, "but|mais|aber"), (400, r"[^.!?\n]{5,}[.][ \n]*[^.!?\n]{2,15}\z")), short_last=True),
        Hook("info", ((400, "that|que|dass"),)),
        Hook("threat", ((400, "against|gegen"),)),
        Hook("question", ((200, "[?]"),)),
        Hook("promise", ((500, "will|wird"),)),
        Hook("system", ((500, "level|[|]"),)),
    ),
    dialogue=r'"[^"\n]+"|“[^”\n]+”',
    ends=".!?",
    lower=True,
)

# The lexicon of the domain. Classes, weights, timings and labels, each with its pattern.
ZH = LexiconPack(
    pleasure={
        "slap": Entry("打脸|嘲讽|看不起|小瞧|轻视|不屑|冷笑|嗤笑|凭什么|你也配|就这|惊呆|震惊|瞪大|倒吸|不可思议|怎么可能|不可能！|傻眼|目瞪口呆|鸦雀无声", 0.096, "instant", "打脸"),
        "level": Entry("突破|晋级|进阶|升级|渡劫|突破瓶颈|实力暴涨|修为大增|顿悟|觉醒|解锁|开启|新生|蜕变|脱胎换骨", 0.086, "instant", "突破"),
        "crush": Entry("碾压|秒杀|横扫|秒败|一击|一招|摧枯拉朽|不堪一击|螳臂当车|随手|轻易|不费吹灰|挥手之间", 0.3, "instant", "碾压"),
        "comeback": Entry("绝地|绝境|反杀|逆转|翻盘|反败为胜|逆转乾坤|置之死地|破而后立|柳暗花明|峰回路转|起死回生|绝处逢生", 0.178, "instant", "绝地反击"),
        "hidden": Entry("扮猪|藏拙|隐藏实力|低调|显露|暴露|亮出|底牌|真正实力|终于出手|不再隐藏", 0.108, "delayed", "扮猪吃虎"),
        # those that speak of you or me count anywhere, the others within thirty characters of a pronoun or gesture
        "bond": Entry(
            "为你|替我|等我|陪你|跟你|我会保护|我答应|只有你|只要你|除了你"
            "|(?<=[你我他她][\\s\\S]{0,29}|(?:眼中|心里|轻声|沉默|握住|凝视)[\\s\\S]{0,28})(?:羁绊|守护|并肩|一起|别走|回来|留下|不放手|伸出手|碰了碰|贴着|靠着|第一[个次位]|唯一|不会让|不许|不行|不准)"
            "|(?:羁绊|守护|并肩|一起|别走|回来|留下|不放手|伸出手|碰了碰|贴着|靠着|第一[个次位]|唯一|不会让|不许|不行|不准)(?=[\\s\\S]{0,29}[你我他她]|[\\s\\S]{0,28}(?:眼中|心里|轻声|沉默|握住|凝视))",
            0.155,
            "delayed",
            "羁绊",
        ),
        "cognitive": Entry("原来如此|明白了|懂了|终于知道|恍然大悟|识破|看穿|洞察|算到|预判|提前|早[就已]|那一瞬|猛然意识|忽然想到|突然想起|面板弹出|推演显示|模拟得出|演算|第一条规则|从未见过", 0.017, "instant", "认知突破"),
        "sacrifice": Entry("燃[烧尽]|耗尽|透支|本源|代价|交换|换[取来]|付出|承受|扛住|撑住|拼了|不管[了不]|豁出去|不计代价|不重要|没关系|值得|心甘情愿", 0.0, "delayed", "牺牲"),
        "strategy": Entry("计策|谋划|布局|算计|预判|先[一]步|棋[高一]?着|将[了]?一军|反[将计]?|设局|做局|套路|坑[了他]|算[计准]?|计划[得通]|顺利|完美|不[出动]所料|果然|果[真不其]然", 0.108, "delayed", "策略"),
        "resource": Entry("收获|获得|得到|入手|到[手账]|收集|囤积|储备|库存|物资|粮食|水源|药[品剂]|武器|装备|弹药|发现了|找到了|挖[到出]|捡[到回]|开[出启]了", 0.108, "instant", "资源"),
        "social": Entry("信[任赖]|托付|交[给托]|认可|承认|接纳|加入|成为[一了]|列入|纳入|吸收|收[编留]|追随|跟随|效忠|臣服|折服|震慑|威[慑压]", 0.108, "delayed", "社交"),
        "backfire": Entry("弄巧成拙|自食恶果|反噬|搬起石头|自作自受|害人终害己|反而帮了|反倒成就|因缺少|偷走.*失败|反而.*突破|反被|反遭|毒计.*反成|阴谋.*反而", 0.108, "instant", "反派反噬"),
        "trap_master": Entry("请君入瓮|精准排雷|引蛇出洞|将计就计|故意中计|假装中计|早已看穿|早就知道|故意.*引诱|故意.*踩入|明知.*陷阱|假装重伤.*引诱|设[下个].*套|等着.*跳", 0.108, "instant", "反陷阱"),
        "knowledge_gap": Entry("降维打击|跨频|现代知识|高维常识|异世界.*常识|这个世界的规则|用.*知识.*解决|脑补|过度解读|高深莫测|暗自心惊|心生敬畏|暗自揣测|随口.*一句|小动作.*被|高人.*解读", 0.108, "instant", "认知碾压"),
        "hidden_value": Entry("变废为宝|废品.*极品|垃圾.*宝物|残次品.*触发|没人要|看不上|不起眼.*隐藏|隐藏.*机制|精准扶贫|绝地.*修炼|恰好.*需要|因祸得福|折磨.*恰好|最[适合]怕.*反而|绝境.*恰好", 0.108, "instant", "隐藏价值"),
        "identity_reveal": Entry("微服私访|大水冲龙王庙|靠山.*是|随手帮助|普通老头|顶级掌权|最高特权|没想到.*竟是|原来.*是|竟[然是].*认识|真是.*有眼不识|不知.*身份|认出.*身份", 0.108, "delayed", "身份反转"),
        "foreshadow_payoff": Entry("拼图归位|最后.*碎片|关键.*碎片|多年.*得到|当年.*无意|终于.*用上|终极.*钥匙|打开.*神门|破石头.*关键|碎片.*完整|伏笔.*回收|埋.*线.*终于", 0.108, "delayed", "伏笔回收"),
    },
    general=Entry("哈哈|爽|痛快|舒服|牛逼|厉害|强[^调化学]|很强|极强|无敌|逆天|恐怖如斯|骇然|惊呼|赞叹|佩服|崇拜|仰望|敬畏", 0.108),
    physio=Entry("瞳孔[骤微]?缩|呼吸[一戛]?滞|心头[一]?[震颤]|脊背发?凉|头皮发麻|血液[仿凝]|浑身[一震]|心头[一]紧|掌心[出渗]|指尖[微发]颤|眼眶[一微]?红|鼻子[一]?酸|喉[咙头][一发]?紧|说不出话|愣[在住]了|沉默[了很]?久|久久[没未不]|一言不发|一动不动|半晌", 0.179),
    conflict={
        "combat": "你敢|休想|去死|找死|不可能！|我不信|凭什么|战斗|厮杀|搏杀|血战|激战|苦战|酣战|大战|对决|决斗|杀意|杀气|怒吼|暴怒|杀机|出手|进攻|攻击|反击|反攻|偷袭|暗算|围杀|刺杀|击杀|斩杀|一刀|一剑|一拳|一掌|一枪|武器|兵器|法宝|神通|禁术|秘术|底牌|拼命|拼死|搏命|殊死|生死|致命|致命一击|决一死战|不死不休",
        "psychological": "试探|算计|博弈|陷阱|圈套|局[中里]|将计就计|反将|识破|怀疑|猜忌|戒备|提防|警觉|怀疑|不信任|动摇|犹豫|迟疑|他知[道晓]|她知[道晓]|没[说有]穿|假装|装作|掩饰|隐藏",
        "moral": "抉择|选择|两条路|牺牲谁|换谁|保谁|救[谁不]|放弃|舍弃|背叛|出卖|欺骗|隐瞒|瞒着|对不起|亏欠|负罪|愧疚|忏悔|底线|原则|不能|不该|不可以|越界|突破底线|做不到",
        "environment": "饥饿|饥渴|干渴|脱水|辐射|污染|毒气|窒息|缺氧|崩塌|坍塌|陷落|废墟|残骸|瓦砾|断壁|极寒|酷暑|严寒|灼热|暴晒|酸雨|变异|异化|侵蚀|吞噬",
        "social": "规则|秩序|权力|夺权|争权|上位|夺位|取而代之|质疑|反对|排斥|驱逐|孤立|排挤|针对|凭什么你|谁同意的|谁允许|规矩|规定|制度|领头|首领|领袖|话语权|说了算|一票否决",
        "suspense": "诡异|恐怖|异常|不详|扭曲|怪异|反常|离奇|奇怪|毛骨悚然|秘密|真相|隐瞒|谎言|背后|暗中|偷偷|悄悄|窥视|监视|阴森|黑暗[中的]|深[处渊底]|未知|不可名状|不可描述|消失|失踪|死去|复活|变异|扭曲|融化|腐[烂杇]|不对劲|有[问]题|有问题|哪里不对|感觉不对|直觉|危[险机]|威胁|逼近|降临|笼罩|弥漫|渗透|蔓延",
    },
    negative="哭|泪|死|痛|绝望|恐惧|害怕|逃|躲|惨|败|输|危险|致命|无奈|苦涩|悲哀|悲凉|凄凉|孤寂|苍凉|毁灭|湮灭|陨落|逝去|悲伤|悲痛|心碎|心寒|心凉|心如死灰|万念俱灰",
    hook=r"就在这时|突然[一之]|忽然|骤然|猛然|只见[那这]|赫然|不料|竟然|居然|竟[然敢会]|下一刻|下一秒|紧接着|与此同时|眼下|眼下这一幕|未完待续|欲知后事|预知后事|危机降临|危险[正即]|不妙|不好[了啦]|糟糕|\?[ \n]*$|难道|莫非|怎么[会可]|为[什]?么|一定会|必定|必将|来日|改日|下次|等着|走着瞧",
    anti_trope="不[想愿打算要]?变强|不[想愿打算要]?升级|不[想愿打算要]?战斗|拒绝[系统金手指]|不要[系统任务]|不想[穿越重生]|[只想只要]?[退休归隐躺平平淡安逸苟着]|[明明已经].*?[却还要].*?[被迫无奈]|系统[呢在哪]|为什么[是我选]|这[不没]科学|太离谱|太荒唐",
    high_emotion="绝望|崩溃|疯狂|怒吼|咆哮|撕心裂肺|痛不欲生|生不如死|狂喜|癫狂|痴狂|失控|失态|歇斯底里|情绪崩溃|精神[崩垮]",
    low_emotion="平静|淡然|释然|坦然|从容|平和|从容|波澜不惊|心如止水|麻木|冷漠|漠然|空洞|放空|放[弃手]|认命|听天由命",
    burnout="累[了极垮]|疲惫|筋疲力尽|精疲力竭|心力交瘁|身心俱疲|乏力|无[能力]为力|撑不住|扛不住|受不了|熬不住",
    hooks=(
        Hook("悬念式", ((300, "竟然|居然|不可能|怎么可能|但[是那]|然而|只不过|不料|谁知[道]?|没想[到过]"),)),
        Hook("情绪炸弹", ((300, "(从[来没]|再也[不没]|永远|终于|最后[一]?)[^。！？]{3,25}$"),)),
        Hook("反转式", ((400, r"([^。！？\n]{5,}。\s*)([^。！？\n]{2,15})$"),), short_last=True),
        Hook("信息投放", ((300, "(翻开|打开|看到|发现|显示|弹出|浮现|亮起|闪烁|跳[出动]|面板|提示|解锁)[^。！？]{3,25}$"),)),
        Hook("威胁式", ((250, "(危险|危机|威胁|杀[机意]|死亡|毁灭|不详|不[妙对]|糟糕|完[了蛋])[^。！？]{0,20}$"),)),
        Hook("疑问式", ((200, r"[？?][ \n]*$"), (250, "(难道|莫非|为[什]?么|怎么[会可])[^。！？]{3,30}$"))),
        Hook("承诺式", ((200, "(一定|必将|必定|来日|改日|下次|等着|走着瞧|不[会能]放[过弃])[^。！？]{2,20}$"),)),
        Hook("系统提示", ((250, "(叮[!！]|系统提示|任务完成|奖励|升级|进化|觉醒|解锁|新[的个]技能)"),)),
    ),
    dialogue='[「『"“](.+?)[」』"”]|[^\\n]*[:：]["“].+["”]',
    emotions=("爽快", "紧张", "悲壮", "悬疑", "日常"),
)

# The simplified classes of the second projection.
RICH_ZH = {
    "hook": {"cliffhanger": "悬念|究竟|到底|未完|待续|下回|欲知", "reversal": "反转|逆袭|翻盘|竟然|原来|真相|秘密", "emotion_bomb": "牺牲|守护|最[后终]|绝不|为了|只为", "info_drop": "透露|揭示|浮现|终于|知道"},
    "conflict": {"combat": "战斗|杀|轰|斩|刺|劈|拳|剑|枪|刀", "psychological": "恐惧|愤怒|绝望|挣扎|崩溃|怀疑|内疚", "moral": "选择|天平|代价|牺牲|背叛", "environmental": "崩塌|毁灭|洪水|地震|毒气|辐射", "social": "排挤|误会|陷害|诬蔑|舆论"},
    "pleasure": {"face_slap": "打脸|反杀|碾压|打翻|吊打|秒杀", "breakthrough": "突破|升级|进阶|觉醒|领悟|融会", "overwhelm": "镇压|横扫|碾压|碾压一切|无敌", "comeback": "绝地|翻盘|逆袭|反败|逆转", "hidden_master": "隐藏|低调|收敛|扮猪|显露|真正实力", "bond": "守护|并肩|托付|生死|交心|羁绊", "cognition": "原来如此|终于明白|恍然大悟|我懂了|悟了", "sacrifice": "牺牲自己|舍身|赴死|以命|拼尽|最后一"},
    "positive": "好|强|厉害|痛快|爽|舒服|赞|惊|震|叹|佩|牛|棒|绝|妙|胜",
    "negative": "恐惧|愤怒|绝望|挣扎|崩溃|怀疑|内疚|悲|痛|苦|恨|忧|愁|惨|伤|死|亡|危|难",
    "physio": "心跳|呼吸|血[液压]|肌肉|骨骼|瞳孔|冷汗|颤抖|颤栗|寒毛|鸡皮|毛孔",
    "letters": "[\\x{4e00}-\\x{9fff}]",
}
RICH_LATIN = {
    "hook": {"cliffhanger": "what|who", "reversal": "but|mais|aber", "emotion_bomb": "love|lieb", "info_drop": "that|dass"},
    "conflict": {"combat": "war|ores", "psychological": "not|nicht", "moral": "pas|ould", "environmental": "erth", "social": "onre|ency"},
    "pleasure": {"face_slap": "ation", "breakthrough": "ering", "overwhelm": "with|avec", "comeback": "ther", "hidden_master": "from", "bond": "and|und", "cognition": "which", "sacrifice": "ment"},
    "positive": "good|bien|gut |able",
    "negative": "no |ill|mal|ver",
    "physio": "blood|herz|ough",
    "letters": "[a-zà-ÿ]",
}
