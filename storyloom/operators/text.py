"""Texts into parts: encodings, chapters, scenes, sections, keywords, speakers, genres. Row to row or row to many, without shuffles unless said."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.columns import SPACE, chinese_number, count, dense, ladder, paragraphs, rounded, span_chars, total

#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "gb18030", "utf-16-le", "utf-16-be")


def encoding(content: Column) -> Column:
    """The encoding of bytes by their mark or by being valid UTF-8; null where only a trial can tell."""
    mark = lambda n, x: F.hex(F.substring(content, 1, n)) == x
    return ladder((mark(3, "EFBBBF"), "utf-8-sig"), (mark(2, "FFFE"), "utf-16-le"), (mark(2, "FEFF"), "utf-16-be"), (F.is_valid_utf8(content.cast("string")), "utf-8"))


@F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    """Bytes as text in the first encoding that fits; null where none does."""

    def one(raw: bytes | None) -> tuple[str | None, str | None]:
        for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
            if raw and raw.startswith(mark):
                return name, raw[len(mark) :].decode(name, "replace")
        for name in ENCODINGS if raw is not None else ():
            try:
                return name, raw.decode(name)
            except UnicodeDecodeError:
                continue
        return None, None

    return pd.DataFrame([one(x) for x in content], columns=["encoding", "text"])


NUMERAL = "[一二三四五六七八九十百千零0-9]+"
#: Headers of chapters, the first kind that gives two chapters counts. Lines end at \n alone. A bare number has to stand on its own line, to be no year, and to be followed by text.
FOLLOWED = "|".join(rf"\s{{{i}}}\S[\s\S]{{18,{48 - i}}}\S" for i in range(31))
HEADERS = (rf"第{NUMERAL}章[^\S\n]*[^\n]*", rf"(?:序章[^\S\n]*[^\n]*|章{NUMERAL}[^\S\n]*[^\n]*)", r"(?md)^[ \t]*[0-9]{1,4}[ \t]+[^0-9\n][^\n]*", rf"(?md)^[ \t]*(?!(?:19|20)[0-9][0-9][ \t]*$)[0-9]{{1,4}}[ \t]*$(?={FOLLOWED})")
LEAST_HEADERS = (2, 2, 2, 3)
LOOSE = (rf"(?i)(?:第{NUMERAL}[章节回]|chapter\s*[0-9]+)[^\n]*",)


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, F.lit(rf"^{SPACE}+|{SPACE}+\z"), F.lit(""))


def extract_chapters(books: DataFrame, key: str = "book", text: str = "text", headers: Sequence[str] = HEADERS, least: Sequence[int] = LEAST_HEADERS, least_chars: int = 50, whole: bool = False) -> DataFrame:
    """(key, place, num, title, body, wc, para_count) of each chapter, in the order of the book. whole: a book without headers is one chapter.

    The last kind of headers that fits decides for a whole book, as its parts lie in one row; the rows of chapters need no shuffle.
    """
    kinds = [F.struct(F.regexp_extract_all(text, F.lit(h), 0).alias("titles"), F.slice(F.split(text, h, -1), 2, 1_000_000).alias("bodies")) for h in headers]
    chosen = F.lit(None)
    for kind, n in reversed(list(zip(kinds, least, strict=False))):
        chosen = F.when(F.size(kind["titles"]) >= n, kind).otherwise(chosen)
    if whole:
        chosen = F.coalesce(chosen, F.struct(F.array(F.lit("")).alias("titles"), F.array(F.col(text)).alias("bodies")))
    rows = books.select(key, chosen.alias("c")).select(key, F.arrays_zip(F.transform("c.titles", trimmed).alias("title"), F.transform("c.bodies", trimmed).alias("body")).alias("z"))
    rows = rows.select(key, F.filter("z", lambda x: F.length(dense(x["body"])) >= least_chars).alias("z"))
    number = lambda t: F.coalesce(F.when(t.rlike(f"^第{NUMERAL}章"), chinese_number(F.regexp_extract(t, f"第({NUMERAL})章", 1))), F.when(t.rlike("^序章"), F.lit(0).cast("long")), F.when(t.rlike(f"^章{NUMERAL}"), chinese_number(F.regexp_extract(t, f"章({NUMERAL})", 1))), F.regexp_extract(t, "([0-9]{1,4})", 1).try_cast("long"), F.lit(0).cast("long"))
    rows = rows.select(key, "z", F.transform("z", lambda x: number(x["title"])).alias("nums"))
    rows = rows.select(key, F.posexplode("z").alias("i", "z"), "nums")
    zero = F.size(F.filter(F.slice("nums", F.lit(1), F.col("i") + 1), lambda n: n == 0))
    num = F.when(F.element_at("nums", F.col("i") + 1) == 0, zero).otherwise(F.element_at("nums", F.col("i") + 1)).cast("long")
    body = F.col("z.body")
    return rows.select(key, (F.col("i") + 1).cast("long").alias("place"), num.alias("num"), F.col("z.title").alias("title"), body.alias("body"), F.length(dense(body)).cast("long").alias("wc"), F.size(paragraphs(body, F.length(dense(body)))).cast("long").alias("para_count"))


def scenes_of(text: str, least: int = 200, most: int = 1500, merge: int = 100, ends: str = "。！？!?") -> list[str]:
    """Scenes of one text: neighbouring short paragraphs joined, long groups cut behind sentences, short rests left out."""
    joined: list[list[str]] = []
    for block in filter(None, (x.strip() for x in re.split(r"\n\s*\n", text.strip()))):
        if joined and (len(block) < merge or len("\n\n".join(joined[-1])) + len(block) < merge):
            joined[-1].append(block)
        else:
            joined.append([block])
    out: list[str] = []
    for group in map("\n\n".join, joined):
        if len(group) <= most:
            out += [group] * (len(group) >= least)
            continue
        piece = ""
        for sentence in re.split(rf"(?<=[{re.escape(ends)}])\s*", group):
            if len(piece) >= least and len(piece) + len(sentence) > most:
                out.append(piece.strip())
                piece = ""
            piece += sentence
        out += [piece.strip()] * (len(piece) >= least)
    return out


def scenes(texts: DataFrame, key: str = "doc_id", text: str = "text", ends: str = ".!?", least: int = 200, most: int = 1500) -> DataFrame:
    """(key, scene, body, chars): the greedy packing of scenes is a fold over sentences, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: scenes_of(x or "", least, most, ends=ends))

    return texts.select(key, F.posexplode(cut(F.coalesce(text, F.lit("")))).alias("scene", "body")).select(key, F.col("scene").cast("long").alias("scene"), "body", F.length("body").cast("long").alias("chars"))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, body) of a Markdown text's level-two sections."""
    blocks = F.slice(F.split(F.concat(F.lit("\n"), text), r"\n## +", -1), 2, 1_000_000)
    each = docs.select(key, F.explode(blocks).alias("b"))
    return each.select(key, trimmed(F.substring_index("b", "\n", 1)).alias("section"), F.when(F.contains("b", F.lit("\n")), trimmed(F.regexp_replace("b", F.lit(r"^[^\n]*\n"), F.lit("")))).otherwise(F.lit("")).alias("body"))


def bullets(docs: DataFrame, key: str, text: str, least: int = 5) -> DataFrame:
    """(key, fact): lines that begin with a bullet or a number, `least` characters and more."""
    facts = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(?:[-*+]|[0-9]+[.])[ \t]+([^\n]*)"), 1)
    return docs.select(key, F.explode(F.transform(facts, trimmed)).alias("fact")).where(F.length("fact") >= least)


def title_and_author(name: Column) -> tuple[Column, Column]:
    """Title and author of a file name: book marks, edition notes and the author's label are dropped."""
    stem = F.regexp_replace(name, F.lit(r"\.[A-Za-z0-9]{1,5}$"), F.lit(""))
    author = F.regexp_extract(stem, "(?:作者[:：]?|[ _-]+by[ _]+)([^ 《》（）()_]+)", 1)
    title = F.regexp_replace(F.regexp_replace(stem, F.lit("(?:作者[:：]?|[ _-]+by[ _]+).*$"), F.lit("")), F.lit("[《》]|[（(][^）)]*[）)]"), F.lit(""))
    return F.trim(title), F.when(author != "", author)


def estimated_words(kilobytes: Column) -> Column:
    return F.round(kilobytes * 1024 / 1.8).cast("long")


def keywords(text: Column, letters: str = "[a-zà-ÿ]", sizes: tuple[int, int] = (5, 9), stop: Sequence[str] = (), most: int = 10) -> Column:
    """Quoted parts, then words of some letters, each once, without stop words: the first `most`."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"\\n]+)"'), 1)
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({letters}{{{sizes[0]},{sizes[1]}}})"), 1), lambda w: ~w.isin([*stop, ""]))
    return F.slice(F.array_distinct(F.concat(quoted, words)), 1, most)


def clipped(text: Column, head: int = 400, tail: int = 800) -> Column:
    """Head and tail of a long text, which stands for it in a prompt; the whole text stays where it is."""
    return F.when(F.length(text) > head + tail, F.concat(F.left(text, F.lit(head)), F.lit("\n...\n"), F.right(text, F.lit(tail)))).otherwise(text)


#: Short keys of labels and what they stand for.
COMPACT_KEYS = {"t": "pleasure_type", "i": "pleasure_intensity", "c": "conflict_level", "e": "emotion", "p": "pace"}


def repaired_labels(raw: Column, keys: dict = COMPACT_KEYS) -> Column:
    """A struct of labels from JSON as models write it: fenced, with words around it, with trailing commas, with short keys."""
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    tidy = F.regexp_replace(F.regexp_replace(inner, F.lit(r",\s*\}"), F.lit("}")), F.lit("[“”]"), F.lit('"'))
    parsed = F.from_json(tidy, "map<string,string>")
    return F.struct(*[F.coalesce(F.try_element_at(parsed, F.lit(long)), F.try_element_at(parsed, F.lit(short))).alias(long) for short, long in keys.items()])


def packed_context(entries: DataFrame, by: str, limits: dict[int, int], chars_per_token: float = 1.5, least: int = 50) -> DataFrame:
    """(by, tier, used, truncated, kept, skipped): of each tier's entries (key, content, priority) those that fit its tokens, by priority; one that does not fit is cut if over `least` tokens are left. A fold over the few entries of a tier."""
    tokens = F.greatest(F.lit(1), F.floor(F.length("content") / chars_per_token)).cast("int")
    limit = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v)])[F.col("tier")]
    packed = entries.select(by, "tier", F.struct((-F.col("priority")).alias("p"), F.col("key").alias("key"), tokens.alias("t"), F.length("content").alias("chars")).alias("e")).groupBy(by, "tier").agg(F.sort_array(F.collect_list("e")).alias("es")).withColumn("most", limit.cast("int"))
    strings = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("cut"), strings.alias("kept"), strings.alias("skipped"), F.col("most").alias("most"))

    def step(s: Column, e: Column) -> Column:
        fits, room = s["used"] + e["t"] <= s["most"], s["most"] - s["used"]
        part = ~fits & (room > least)
        chars = F.floor(room * chars_per_token).cast("int")
        cut_tokens = F.when(e["chars"] <= chars, e["t"]).otherwise(F.greatest(F.lit(1), F.floor(chars / chars_per_token)).cast("int"))
        return F.struct(F.when(fits, s["used"] + e["t"]).when(part, s["used"] + cut_tokens).otherwise(s["used"]).alias("used"), (s["cut"] | ~fits).alias("cut"), F.when(fits | part, F.array_append(s["kept"], e["key"])).otherwise(s["kept"]).alias("kept"), F.when(~fits, F.array_append(s["skipped"], e["key"])).otherwise(s["skipped"]).alias("skipped"), s["most"].alias("most"))

    done = packed.select(by, "tier", F.aggregate("es", start, step).alias("r"))
    return done.select(by, "tier", F.col("r.used").cast("long").alias("used"), F.col("r.cut").alias("truncated"), F.concat_ws(",", "r.kept").alias("kept"), F.concat_ws(",", "r.skipped").alias("skipped"))


def tier_limits(total_tokens: int, ratios: dict[int, float], deltas: dict[int, float]) -> dict[int, int]:
    """Tokens of each tier: shares moved by the kind of chapter, 5 % at least, then made to sum to one."""
    moved = {k: max(0.05, v + deltas.get(k, 0)) for k, v in ratios.items()}
    return {k: int(total_tokens * v / sum(moved.values())) for k, v in moved.items()}


def detect_genre(books: DataFrame, lexicon: dict[str, dict[str, float]], titles: dict[str, str], key: str = "doc_id", name: str = "name", text: str = "text", least: float = 2.0, margin: float = 0.7, unsure: float = 0.3) -> DataFrame:
    """(key, genre, primary, secondary, confidence, method): the longest title word decides, else weighted counts of words; close seconds make the single genre unknown. One narrow pass; the lexicon is an expression."""
    c = F.col
    by_title = ladder(*[(F.contains(name, F.lit(w)), g) for w, g in sorted(titles.items(), key=lambda x: (-len(x[0]), x[0]))])
    scored = books.select(key, by_title.alias("titled"), *[total([count(F.coalesce(text, F.lit("")), re.escape(w)) * float(x) for w, x in words.items()]).alias(f"s_{g}") for g, words in lexicon.items()])
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.round(c(f"s_{g}"), 2)).alias("m"), F.lit(g).alias("g")) for g in lexicon]), lambda x: x["m"] < 0))
    r = scored.select(key, "titled", ranked.alias("r")).select(key, "titled", "r", (-F.try_element_at("r", F.lit(1))["m"]).alias("top"), F.try_element_at("r", F.lit(1))["g"].alias("best"), (-F.try_element_at("r", F.lit(2))["m"]).alias("second"), F.aggregate("r", F.lit(0.0), lambda a, x: a - x["m"]).alias("sum"))
    confidence = rounded(F.round(c("top") / F.greatest("sum", F.lit(1.0)), 9), 3)
    weak = c("top").isNull() | (c("top") < least)
    single = F.when(c("titled").isNotNull(), c("titled")).when(weak | (F.coalesce("second", F.lit(0.0)) > c("top") * margin), "unknown").otherwise(c("best"))
    close = F.when(c("titled").isNull() & ~weak, F.concat_ws(",", F.transform(F.filter(F.slice("r", 2, 100), lambda x: -x["m"] > c("top") * margin), lambda x: x["g"]))).otherwise(F.lit(""))
    method = ladder((c("titled").isNotNull(), "title"), (c("top").isNull(), "unknown"), (c("top") < least, "keywords"), (confidence < unsure, "keywords_unsure"), otherwise="keywords")
    return r.select(key, single.alias("genre"), F.coalesce("titled", F.when(weak, "unknown").otherwise(c("best"))).alias("primary"), close.alias("secondary"), F.when(c("titled").isNotNull(), F.lit(0.95)).when(weak, F.lit(0.0)).otherwise(F.least(confidence, F.lit(1.0))).alias("confidence"), method.alias("method"))


def basic_filter(books: DataFrame, known: Sequence[str] = (), key: str = "doc_id", name: str = "name", text: str = "text", least_kb: int = 200, large_kb: int = 5000, least_chapters: int = 5, least_density: float = 0.4, letters: str = r"[\x{4e00}-\x{9fff}]", header: str = "(?i)第[零一二三四五六七八九十百千0-9]+[章节回]|Chapter\\s*[0-9]+", head_chars: int | None = 10_000) -> DataFrame:
    """(key, passed, reason): entry checks of a raw book in their order. Headers and letters are counted in the head of the text, as the checks are defined; None takes the whole."""
    c = F.col
    body = F.coalesce(F.col(text), F.lit(""))
    head = body if head_chars is None else F.left(body, F.lit(head_chars))
    base = books.select(key, name, F.floor(F.octet_length(body) / 1024).alias("kb"), count(head, header).alias("chapters"), (count(head, letters) / F.greatest(F.length(dense(head)), F.lit(1))).alias("density"), count(body, letters).alias("letters"))
    n = F.when(c("kb") > large_kb, F.lit(least_chapters)).otherwise(c("chapters"))
    per = c("letters") / F.greatest(n, F.lit(1))
    named = c(name).rlike("|".join(map(re.escape, known))) if known else F.lit(False)
    reason = ladder((named, "known"), (c("kb") < least_kb, "too_small"), (n < least_chapters, "few_chapters"), (c("density") < least_density, "few_letters"), ((c("kb") <= large_kb) & ((per > 50000) | ((per < 200) & (n >= 10))), "odd_chapters"), otherwise="ok")
    return base.select(key, reason.isin("known", "ok").alias("passed"), reason.alias("reason"))


def speakers(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, speaker, lines, chars): what a text says who says, by a pattern with a name and a quotation."""
    said = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("who"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("what"))
    return docs.select(key, F.explode(said).alias("s")).groupBy(key, F.col("s.who").alias("speaker")).agg(F.count("*").alias("lines"), F.sum(F.length("s.what")).alias("chars"))


def frequent_names(docs: DataFrame, pattern: str, text: str = "text", most: int = 20) -> DataFrame:
    """(name, n, place, role): the names that stand before a verb of speech most often; counts are summed before they meet."""
    n = docs.select(F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1)).alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "name")).cast("long")  # at most `most` rows
    return n.select("name", "n", place.alias("place")).withColumn("role", ladder((F.col("place") == 1, "protagonist"), (F.col("place") <= 5, "major"), otherwise="supporting"))


def line_findings(docs: DataFrame, categories: dict[str, str], severities: Sequence[tuple[str, str]], key: str, text: str) -> DataFrame:
    """(key, line, categories, severity): lines of a review that speak of a category, with the first severity whose words they have."""
    each = docs.select(key, F.posexplode(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")).alias("line", "t"))
    of = F.concat_ws(",", F.array_compact(F.array(*[F.when(F.col("t").rlike(p), F.lit(c)) for c, p in categories.items()])))
    severity = ladder(*[(F.col("t").rlike(p), s) for s, p in severities], otherwise="info")
    return each.select(key, F.col("line").cast("long").alias("line"), of.alias("categories"), severity.alias("severity")).where("categories <> ''")


def quoted_share(text: Column, pattern: str) -> Column:
    return rounded(span_chars(text, pattern) / F.greatest(F.length(text), F.lit(1)), 3)
