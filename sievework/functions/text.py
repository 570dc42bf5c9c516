"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN = r"[\p{L}\p{N}]+"

# fixed values: outline rules in the order they are tried, by name
TITLE_RULES = {
    "CN_CHAPTER": "^第[一二三四五六七八九十百千]+章",
    "CN_PART": "^第[一二三四五六七八九十百千]+部分",
    "CN_SECTION": "^第[一二三四五六七八九十百千]+节",
    "CN_ARTICLE": "^第[一二三四五六七八九十百千]+篇",
    "CN_ITEM": "^第[一二三四五六七八九十百千]+条",
    "NUM_CHAPTER": "^第[0-9]+章",
    "NUM_PART": "^第[0-9]+部分",
    "NUM_SECTION": "^第[0-9]+节",
    "NUM_ARTICLE": "^第[0-9]+篇",
    "NUM_ITEM": "^第[0-9]+条",
    "NUM_DECIMAL": r"^\d+(\.\d+)+",
    "NUM_SIMPLE": r"^\d+[\s\x{3000}]+",
    "CN_LIST": "^[一二三四五六七八九十]+、",
}
# fixed values: lines that look like parameters
PARAMETER_LINES = [
    r"^\s*[\p{L}\p{N}_]+\s*=\s*.+",
    r"^\s*[\p{L}\p{N}_]+\s*:\s*.+",
    r"^\s*[\p{L}\p{N}_]+\s*：\s*.+",
    r"^\s*[\"'\{\[\(].*",
    r"^\s*-\s+[\p{L}\p{N}_]+\s*:",
    r"^\s*[\p{L}\p{N}_]+\s*\|\s*",
]


def tokens(text: Column, lower: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """The default length of a text in tokens; a tokenizer's count can be passed to the operators instead."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def grams(text: Column, n: int = 3) -> Column:
    """A text's distinct runs of 1 to n characters."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.transform(places, lambda i: F.substr(text, i, k)))))


def clean(text: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{3000}]+", " "))


def strip(text: Column) -> Column:
    """A text without white space at its ends, line ends included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_title(text: Column) -> Column:
    """A title without the page number at its end."""
    return F.trim(F.regexp_replace(text, r"\s*[0-9]+\s*$", ""))


def title_rule(text: Column) -> Column:
    """The first rule that a cleaned line matches, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(TITLE_RULES.items()):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def is_parameter_line(line: Column) -> Column:
    out = F.lit(False)
    for p in PARAMETER_LINES:
        out = out | line.rlike(p)
    return out


def page_number(text: Column) -> Column:
    """The number in a page mark (第 n 页, n 页, n, or n / m), else null."""
    t = F.trim(text)
    got = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return F.coalesce(got(r"^第\s*([0-9]+)\s*页$"), got(r"^([0-9]+)\s*页$"), got(r"^-?\s*([0-9]+)\s*-?$"), got(r"^([0-9]+)\s*/\s*[0-9]+$")).cast("int")


# fixed values: page marks by format, in the order they are tried; the pure one has at most three digits
PAGE_MARKS = {"chinese": r"第\s*(\d+)\s*[页节条款]", "slash": r"^\s*(\d+)\s*[\\/]\s*\d+\s*$", "page_en": r"[Pp]age\s*(\d+)", "pure": r"^\s*(\d{1,3})\s*$"}


def page_mark(text: Column) -> Column:
    """(num, format) of the page mark in a line, else null."""
    out = F.lit(None).cast("struct<num:int,format:string>")
    for name, pattern in reversed(PAGE_MARKS.items()):
        num = F.regexp_extract(text, pattern, 1)
        out = F.when(num != "", F.struct(num.try_cast("int").alias("num"), F.lit(name).alias("format"))).otherwise(out)
    return out


# fixed values: what a site adds to its titles, containers of main texts, references
TITLE_SUFFIX = " | 在鸿云文档"
CONTAINERS = [r'(?s)<div[^>]*class="vp-doc[^"]*"[^>]*>(.*?)</div>\s*</main>', r'(?s)<main[^>]*class="main[^"]*"[^>]*>.*?<div[^>]*>(.*?)</div>\s*</main>']
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def html_title(html: Column) -> Column:
    found = F.regexp_extract(html, "<title>([^<]+)</title>", 1)
    return F.when(found != "", F.trim(F.replace(found, F.lit(TITLE_SUFFIX), F.lit("")))).otherwise("未知标题")


def html_content(html: Column) -> Column:
    """Text of the main container; pages without one fall back to their article element."""
    pick = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    body = F.coalesce(*[pick(c) for c in CONTAINERS], pick(r"(?s)<article[^>]*>(.*?)</article>"), F.lit(""))
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<script[^>]*>.*?</script>", ""), "<[^>]+>", "\n")
    for a, b in REFERENCES:
        body = F.replace(body, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(body, "\n+", "\n"), " +", " "))


# fixed values: words that route a question to a module, first hit wins
MODULES = {
    "device": ["设备", "设备管理", "物模型", "ota", "ota升级", "产品", "设备注册", "设备列表", "device", "tlink"],
    "safety": ["安全", "认证", "证书", "id2", "加密", "签名", "token", "鉴权", "safety", "cert", "iot"],
    "appstore": ["应用", "应用市场", "原子化", "卡片", "app", "appstore"],
    "auth": ["认证", "token", "鉴权", "登录", "auth"],
    "common": ["天气", "定位", "通用服务", "weather", "common"],
    "zaiohos": ["在鸿os", "openharmony", "arkts", "鸿蒙", "os", "zaiohos"],
    "ai": ["ai", "大模型", "模型", "agent", "语音", "tts", "asr", "智能", "chat", "model"],
}


def module_of(query: Column) -> Column:
    q = F.lower(query)
    out = F.lit(None).cast("string")
    for name, words in reversed(MODULES.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def json_block(answer: Column) -> Column:
    """The JSON text of a model's answer: a fenced block, else from the first { to the last }, else null."""
    fenced = F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit("")))


def answer_object(answer: Column, schema: str) -> Column:
    """The JSON object of a model's answer as a struct, fields null where it has none; raw line ends inside strings don't break it."""
    return F.from_json(F.translate(json_block(answer), "\n\r", " "), schema)


def answer_entities(answer: Column) -> Column:
    """The entities (text, type, chunk_index, description) of a model's answer; those without text or type are left out, none if it can't be read."""
    found = answer_object(answer, "entities array<struct<text:string,type:string,chunk_index:int,description:string>>")["entities"]
    whole = F.filter(found, lambda e: e["text"].isNotNull() & e["type"].isNotNull())
    filled = F.transform(whole, lambda e: F.struct(e["text"].alias("text"), e["type"].alias("type"), F.coalesce(e["chunk_index"], F.lit(0)).alias("chunk_index"), F.coalesce(e["description"], F.lit("")).alias("description")))
    return F.coalesce(filled, F.array().cast("array<struct<text:string,type:string,chunk_index:int,description:string>>"))


# fixed values: how a model's thinking and its answer begin, and what an empty answer becomes
THINKING, ANSWER = ("思考：", "思考:"), "答案："
EMPTY_ANSWER = "抱歉，无法生成答案。"


def clean_answer(answer: Column) -> Column:
    """An answer without its thinking, which runs from a line that begins with its mark to one that begins with the answer's; an empty one is the apology."""
    thinks = lambda line: line.startswith(THINKING[0]) | line.startswith(THINKING[1])
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, line: Column) -> Column:
        answers = a["skip"] & line.startswith(ANSWER)
        kept = F.when(answers, F.concat(a["kept"], F.array(F.substring(line, len(ANSWER) + 1, 2**31 - 1)))).when(a["skip"], a["kept"]).otherwise(F.concat(a["kept"], F.array(line)))
        return F.when(thinks(line), F.struct(F.lit(True).alias("skip"), a["kept"].alias("kept"))).otherwise(F.struct((a["skip"] & ~answers).alias("skip"), kept.alias("kept")))

    left = F.aggregate(F.split(strip(answer), "\n", -1), start, step, lambda a: strip(F.array_join(a["kept"], "\n")))
    return F.when(F.coalesce(answer, F.lit("")) == "", EMPTY_ANSWER).otherwise(left)
