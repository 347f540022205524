"""Text functions: normalising, splitting, noise, tags, parsing of model output and of rendered sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rewrites of platform codes, in order.
REWRITES = (
    (r"\[CQ:at,[^\]]*\]", "@用户"),
    (r"\[CQ:reply,[^\]]*\]", ""),
    (r"\[CQ:image,[^\]]*\]", "[图片]"),
    (r"\[CQ:m?face,[^\]]*\]", "[表情]"),
    (r"\[CQ:record,[^\]]*\]", "[语音]"),
    (r"\[CQ:video,[^\]]*\]", "[视频]"),
    (r"\[CQ:(?:json|xml|rich),[^\]]*\]", "[卡片]"),
    (r"\[CQ:[^\]]*\]", ""),
)
NUMBER_SUFFIX = r"\(([0-9]{5,})\)"
#: Separators of words, and words that are no tags.
SEPARATORS = r"[\s，。！？、,!?]+"
STOPWORDS = (
    "[图片]", "[表情]", "[语音]", "[视频]", "[卡片]", "@用户",
    "这个", "那个", "什么", "怎么", "可以", "已经", "还是", "但是",
    "因为", "所以", "如果", "或者", "我们", "你们", "他们",
)
#: Prefixes and characters, and the suffix and code fence above and below.
STOP_PREFIXES = ("@", "#", "http://", "https://", "qq=")
EMOJI = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{200D}]+"
TRAITS = ("O", "C", "E", "A", "N")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_message(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern, by in REWRITES:
        out = F.regexp_replace(out, pattern, by)
    return squeeze(F.regexp_replace(out, NUMBER_SUFFIX, ""))


def normalize_name(name: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(name, F.lit("")), NUMBER_SUFFIX, ""))


def words(text: Column) -> Column:
    """Words between separators; empty ones stay, as a split gives them."""
    return F.split(text, SEPARATORS)


def is_word_tag(word: Column) -> Column:
    """2 to 12 characters, no stop word, no number, no address."""
    stop = F.lit(False)
    for prefix in STOP_PREFIXES:
        stop = stop | word.startswith(prefix)
    return F.length(word).between(2, 12) & ~word.isin(*STOPWORDS) & ~word.rlike("^[0-9]+$") & ~stop


def is_tag(tag: Column) -> Column:
    """No identifier: not empty, at most 30 characters, no run of digits, no UUID."""
    uuid = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    bare = strip(tag)
    return (F.length(bare) > 0) & (F.length(bare) <= 30) & ~bare.rlike("^[0-9]{5,}$") & ~bare.rlike(uuid)


def is_noise(text: Column) -> Column:
    """Fewer than 3 characters, with or without emoji, or one character makes up over 70 % of more than 5."""
    clean = strip(F.coalesce(text, F.lit("")))
    n = F.length(clean)
    # a character that makes up over half stands in the middle of all in order: the only one to count
    middle = F.element_at(F.array_sort(F.regexp_extract_all(clean, F.lit("(?s)."), F.lit(0))), (n / 2).cast("int") + 1)
    most = F.when(n > 5, n - F.length(F.replace(clean, middle, F.lit("")))).otherwise(0)
    return (
        (n < 3)
        | (F.length(strip(F.regexp_replace(clean, EMOJI, ""))) < 3)
        | ((n > 5) & (most > 0.7 * n))
    )


def truncate(text: Column, limit: int) -> Column:
    """White space collapsed; what is too long ends in an ellipsis."""
    flat = squeeze(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, max(0, limit - 1)), F.lit("…")))


def tokens(text: Column) -> Column:
    """Estimated model tokens: two characters each, one at least."""
    return F.greatest(F.lit(1), (F.length(text) / 2).cast("int"))


def age_label(seconds: Column) -> Column:
    """Minutes (one at least), hours or days ago."""
    whole = lambda unit: (seconds / unit).cast("long").cast("string")
    return (
        F.when(seconds < 3600, F.concat(F.greatest(F.lit(1), (seconds / 60).cast("long")).cast("string"), F.lit("分钟前")))
        .when(seconds < 86400, F.concat(whole(3600), F.lit("小时前")))
        .otherwise(F.concat(whole(86400), F.lit("天前")))
    )


def hours_label(seconds: Column) -> Column:
    """Whole hours below a day, else days; what lies ahead counts below zero."""
    whole = lambda unit: F.floor(seconds / unit).cast("string")
    return F.when(seconds < 86400, F.concat(whole(3600), F.lit("小时前"))).otherwise(F.concat(whole(86400), F.lit("天前")))


def strip_thoughts(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def percent_of_trait(value: Column) -> Column:
    return F.rint((value + 1) / 2 * 100).cast("int")


def json_object(text: Column) -> Column:
    """The object of a model's answer as a variant, whatever it holds: inside a code fence if there is one; null if it can't be read."""
    found = F.try_parse_json(json_body(text, "{", "}"))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


#: What stands in for a missing orientation and a missing position, and the sentences of a mood.
NO_ORIENTATION, NO_POSITION = "亲和", "未知"
POSITION = "[%s处于群体中的%s位置]"
MOOD = "群体情感动态整体偏向[%s] | [平均亲和度：%+.2f；平均支配度：%+.2f] | "


def mood_text(answer: Column, people: Column) -> Column:
    """A model's mood object as text: the overall orientation, and who stands where; null if there is no object.

    ``people``: array of (uid, name). Positions are texts, or objects with an ``orientation`` or a ``position``; people that the
    answer leaves out stand at the unknown one. Positions come in the order of their first uid, as variants order their keys.
    """
    v = json_object(answer)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    entries = F.coalesce(F.map_entries(get("$.positions", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    own = lambda x, path: F.try_variant_get(x, path, "string")
    is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    place = lambda x: F.when(is_object(x), F.coalesce(own(x, "$.orientation"), own(x, "$.position"), F.lit(NO_POSITION))).otherwise(F.coalesce(own(x, "$"), F.lit("None")))
    named = lambda uid: F.coalesce(F.get(F.filter(people, lambda p: p["uid"] == uid), F.lit(0))["name"], uid)
    placed = F.transform(entries, lambda e: F.struct(named(e["key"]).alias("name"), place(e["value"]).alias("label")))
    covered = F.transform(placed, lambda x: x["name"])
    missing = F.array_sort(F.array_except(F.transform(people, lambda p: F.coalesce(p["name"], p["uid"])), covered))
    every = F.concat(placed, F.transform(missing, lambda n: F.struct(n.alias("name"), F.lit(NO_POSITION).alias("label"))))
    labels = F.array_distinct(F.transform(every, lambda x: x["label"]))
    names = lambda label: F.array_join(F.transform(F.filter(every, lambda x: x["label"] == label), lambda x: x["name"]), ", ")
    positions = F.array_join(F.transform(labels, lambda label: F.format_string(POSITION, names(label), label)), " | ")
    number = lambda path: F.coalesce(get(path, "double"), F.lit(0.0))
    head = F.format_string(MOOD, F.coalesce(get("$.orientation", "string"), F.lit(NO_ORIENTATION)), number("$.benevolence"), number("$.power"))
    return F.when(v.isNotNull(), F.concat(head, positions))


def affect_label(value: Column) -> Column:
    sign = F.when(value >= 0.6, "positive").when(value <= -0.6, "negative").otherwise("neutral")
    return F.concat(sign, F.format_string(" (%+.2f)", value))


def json_body(text: Column, opening: str, closing: str) -> Column:
    """What stands between the first opening and the last closing bracket, inside a code fence if there is one."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    return F.regexp_extract(body, rf"(?s)(\{opening}.*\{closing})", 1)


_ITEMS = (
    "array<struct<start_idx:int,end_idx:int,topic:string,summary:string,chat_content_tags:array<string>,"
    "salience:double,confidence:double,inherit:boolean,participants_personality:string>>"
)


def parse_extraction(text: Column, last: Column) -> Column:
    """Valid items of a model's JSON array: all keys there, indices within 0..last, fields cut and clamped."""
    items = F.from_json(json_body(text, "[", "]"), _ITEMS)
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.5))))
    whole = lambda x: (
        x.start_idx.isNotNull() & x.end_idx.isNotNull() & x.topic.isNotNull() & x.summary.isNotNull()
        & x.chat_content_tags.isNotNull() & (x.start_idx >= 0) & (x.end_idx <= last) & (x.start_idx <= x.end_idx)
    )
    return F.transform(
        F.filter(items, whole),
        lambda x: F.struct(
            x.start_idx.alias("start_idx"),
            x.end_idx.alias("end_idx"),
            F.substring(x.topic, 1, 60).alias("topic"),
            x.summary.alias("summary"),
            F.transform(F.slice(x.chat_content_tags, 1, 5), lambda t: F.substring(t, 1, 30)).alias("tags"),
            share(x.salience).alias("salience"),
            share(x.confidence).alias("confidence"),
            F.coalesce(x.inherit, F.lit(False)).alias("inherit"),
        ),
    )


def parse_traits(text: Column) -> Column:
    """map<name, struct<scores map<trait, double>, evidence>> of a JSON object, nested or flat, clamped to [-1, 1]."""
    raw = F.from_json(text, "map<string,string>")

    def one(_, value):
        nested = F.get_json_object(value, "$.scores")
        scores = F.from_json(F.coalesce(nested, value), "map<string,double>")
        known = F.map_filter(scores, lambda k, v: k.isin(*TRAITS) & v.isNotNull())
        return F.struct(
            F.transform_values(known, lambda k, v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))).alias("scores"),
            F.substring(F.when(nested.isNotNull(), F.get_json_object(value, "$.evidence")), 1, 200).alias("evidence"),
        )

    return F.map_filter(F.transform_values(raw, one), lambda k, v: F.size(v.scores) > 0)


def parse_topics(text: Column) -> Column:
    """array<struct<what, who, how, eval>> of ``[What] .. [Who] .. | ..``."""
    part = lambda x, name: strip(F.regexp_extract(x, rf"\[{name}\]([^\[]*)", 1))
    return F.transform(
        F.filter(F.split(text, r"\|"), lambda x: strip(x) != ""),
        lambda x: F.struct(*(part(x, name).alias(name.lower()) for name in ("What", "Who", "How", "Eval"))),
    )


def section(text: Column, marker: str) -> Column:
    """Text behind ``## marker`` up to the next heading."""
    return strip(F.regexp_extract(text, rf"(?s)##\s*{marker}[^\n]*\n(.*?)(?:\n##|\z)", 1))


def with_percent(text: Column, percent: Column, limit: int = 120) -> Column:
    """The first ``limit`` characters, with every percentage set to ``percent``."""
    return F.regexp_replace(F.substring(text, 1, limit), F.lit(r"[0-9]+%"), F.concat(percent.cast("string"), F.lit("%")))


#: Fixed value: the namespace of URLs in name-based identifiers.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version 5 identifier of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda start, n: F.substring(h, start + 1, n)
    variant = F.lower(F.hex(F.conv(part(16, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws("-", part(0, 8), part(8, 4), F.concat(F.lit("5"), part(13, 3)), F.concat(variant, part(17, 3)), part(20, 12))


def session_id(platform: Column, group: Column, person: Column) -> Column:
    """``platform:group``, or ``platform:private:person`` without a group."""
    return F.when(group.isNotNull() & (group != ""), F.concat_ws(":", platform, group)).otherwise(F.concat_ws(":", platform, F.lit("private"), person))
