"""Column expressions: text, hashing, time, geometry and option arrays."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: added to a time before it is compared with a frame's or event's time.
TICK = 1e-6


def tokens(text: Column) -> Column:
    """Lower-case runs of a to z."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


#: How a model's text names its choice, in the order of trial; {0} stands for the allowed letters.
#: \\b of the original is a boundary of Unicode words, written here as looks behind and ahead.
CHOICE_PATTERNS = (
    r"(?is)<answer>.*?(?<![\p{{L}}\p{{N}}_])([{0}])(?![\p{{L}}\p{{N}}_]).*?</answer>",
    r"(?i)(?:answer|答案|选项|choice)\s*[:：]?\s*\(?([{0}])\)?",
    r"(?i)^\s*\(?([{0}])\)?(?:\s|$|[。,.，])",
    r"(?i)(?<![\p{{L}}\p{{N}}_])([{0}])(?![\p{{L}}\p{{N}}_])",
)


def extract_choice(text: Column, options: int) -> Column:
    """The option letter a model's text names: in an answer tag, after a word for it, in front, or alone; null without one."""
    allowed, own = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[:options], F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.coalesce(*[F.upper(F.nullif(F.regexp_extract(own, p.format(allowed), 1), F.lit(""))) for p in CHOICE_PATTERNS])


def words_of_camel(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z])", " "))


def question_stem(prompt: Column) -> Column:
    """What follows the last `Question: `."""
    return F.element_at(F.split(prompt, "Question: "), -1)


def time_mentions(text: Column) -> Column:
    """All numbers of seconds named in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*s\b"), F.lit(1)), lambda x: x.cast("double"))


def normalised_question(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


@F.pandas_udf(T.StringType())
def question_digest(text: pd.Series) -> pd.Series:
    """SHA-256 of a text, whitespace collapsed and case folded (Spark's lower keeps an eszett)."""
    return text.map(lambda t: None if not isinstance(t, str) else hashlib.sha256(re.sub(r"\s+", " ", t).strip().casefold().encode()).hexdigest())


def with_time(text: Column, seconds: Column) -> Column:
    """Puts a time with two decimals where a text says `at or before N seconds`."""
    return F.regexp_replace(text, F.lit(r"at or before [0-9.]+ seconds"), F.concat(F.lit("at or before "), F.format_string("%.2f", seconds), F.lit(" seconds")))


def safe_id(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")


def hash_int(text: Column) -> Column:
    """The first four bytes of SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def hash_wide(text: Column) -> Column:
    """The first eight bytes of SHA-256; more than a long holds."""
    high, low = (F.conv(F.substring(F.sha2(text, 256), k, 8), 16, 10).cast("decimal(20,0)") for k in (1, 9))
    return (high * F.lit(4294967296).cast("decimal(20,0)") + low).cast("decimal(20,0)")


def anonymous_id(path: Column) -> Column:
    return F.concat(F.lit("video_"), F.substring(F.sha2(path, 256), 1, 16))


def stable_digest(record: Column, length: int = 64) -> Column:
    """SHA-256 of a record's JSON with keys in order."""
    return F.substring(F.sha2(F.to_json(record), 256), 1, length)


def option_permutation(name: Column, count: Column) -> Column:
    """Option numbers in the order of the hashes of `name:number`."""
    ranked = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.sha2(F.concat(name, F.lit(":"), i.cast("string")), 256).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(ranked), lambda x: x["i"])


def lettered(stem: Column, options: Column) -> Column:
    """A prompt: the stem, then one line for each option."""
    return F.concat_ws("\n", stem, F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n"))


def length_rank(option: Column, group: Column) -> Column:
    """Place of an option in its group by length, then text."""
    order = lambda o: F.struct(F.length(o).alias("n"), o.alias("o"))
    return F.array_position(F.array_sort(F.transform(group, order)), order(option)).cast("long") - 1


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(values)


def sorted_spans(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(spans))


def pad_to_multiple(values: Column, multiple: int) -> Column:
    """Repeats the last element until the length is a multiple."""
    missing = F.pmod(-F.size(values), F.lit(multiple))
    return F.when(F.size(values) == 0, values).otherwise(F.concat(values, F.array_repeat(F.element_at(values, -1), missing)))


def last_of(values: Column, most: int) -> Column:
    return F.when(F.size(values) > most, F.slice(values, -most, most)).otherwise(values) if most > 0 else values


def intensity_bin(value: Column, style: str = "scoring") -> Column:
    """1-3, 4-6, 7-10; `filter` takes all above 6 as high, `stream` names ranges."""
    v = value.cast("int")
    if style == "filter":
        return F.when(v <= 3, "low").when(v <= 6, "medium").when(v > 6, "high")
    names = ("1-3", "4-6", "7-10") if style == "stream" else ("low", "medium", "high")
    return F.when(v.between(1, 3), names[0]).when(v.between(4, 6), names[1]).when(v.between(7, 10), names[2])


def age_bin(age: Column, style: str = "scoring") -> Column:
    """Under or from ten seconds; scoring gives negative ages no group, the filter puts them in the lower."""
    if style == "filter":
        return F.when(age >= 10, "ge10s").when(age.isNotNull(), "lt10s")
    return F.when((age >= 0) & (age < 10), "lt10s").when(age >= 10, "ge10s")


def evidence_window(query_time: Column, first: Column, frames: int) -> Column:
    """Whether evidence starts before the frames that are kept."""
    return F.when(first < F.floor(query_time + TICK) - (frames - 1) - TICK, "earlier").otherwise(f"last{frames}")


def frame_interval(start: Column, end: Column, fps: float) -> tuple[Column, Column]:
    return F.ceil(start * fps - TICK), F.ceil(end * fps - TICK)


def sample_floor(x: Column, most: Column) -> Column:
    return F.least(F.greatest(F.floor(x + 1e-9), F.lit(0)), most)


def sample_ceil(x: Column, most: Column) -> Column:
    return F.least(F.greatest(F.ceil(x - 1e-9), F.lit(0)), most)


def gap_midpoint(left: Column, right: Column, most: Column) -> Column:
    return F.least(F.greatest(F.floor((left + right) / 2), F.lit(0)), most)


def wrap_angle(target: Column, source: Column) -> Column:
    return F.pmod(target - source + 180, F.lit(360)) - 180


def planar_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Of a point from a segment."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / square, F.lit(0.0)), F.lit(1.0)))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def turn_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Degrees between the steps a to b and b to c."""
    ux, uy, vx, vy = bx - ax, by - ay, cx - bx, cy - by
    size = F.hypot(ux, uy) * F.hypot(vx, vy)
    return F.when(size > 0, F.degrees(F.acos(F.least(F.greatest((ux * vx + uy * vy) / size, F.lit(-1.0)), F.lit(1.0)))))


def round_by_factor(x: Column, factor: int) -> Column:
    return (F.bround(x / factor) * factor).cast("long")


def smart_resize(height: Column, width: Column, factor: int, least: int, most: int) -> tuple[Column, Column]:
    """Height and width as multiples of the factor with a pixel count between least and most."""
    h, w = F.greatest(F.lit(factor), round_by_factor(height, factor)), F.greatest(F.lit(factor), round_by_factor(width, factor))
    down, up = F.sqrt(height * width / F.lit(most)), F.sqrt(F.lit(least) / (height * width))
    shrink = lambda x: F.greatest(F.lit(factor), F.floor(x / down / factor) * factor)
    grow = lambda x: F.ceil(x * up / factor) * factor
    pick = lambda x, own: F.when(h * w > most, shrink(x)).when(h * w < least, grow(x)).otherwise(own).cast("long")
    return pick(height, h), pick(width, w)


def colour_key(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def colours_match(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Each channel within 1, or all together within 3."""
    gaps = [F.abs(x - y) for x, y in zip(a, b, strict=True)]
    return (F.greatest(*gaps) <= 1) | (gaps[0] + gaps[1] + gaps[2] <= 3)


def nearest(value: Column, allowed: Column, within: float) -> Column:
    """The nearest allowed value, or null beyond the tolerance."""
    best = F.array_min(F.transform(allowed, lambda x: F.struct(F.abs(x - value).alias("gap"), x.alias("x"))))
    return F.when(best["gap"] <= within, best["x"])


def room_of_scene(scene: Column) -> Column:
    n = F.nullif(F.regexp_extract(scene, r"(\d+)$", 1), F.lit("")).cast("int")
    return F.when(n < 200, "kitchen").when(n < 300, "living room").when(n < 400, "bedroom").when(n.isNotNull(), "bathroom")


def json_answer(raw: Column, schema: str) -> Column:
    """A JSON value in a text, with or without a code fence; null if it doesn't parse."""
    inner = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), raw)
    return F.when(~inner.rlike(r"\b(NaN|Infinity)\b"), F.from_json(inner, schema))


def processing_windows(duration: Column, size: float, tail: float) -> Column:
    """Starts and ends of tumbling windows; a short last one is merged with the one before."""
    whole = F.greatest(F.lit(1), F.floor(duration / size) + F.when(duration - F.floor(duration / size) * size >= tail, 1).otherwise(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.struct((i * size).alias("start"), F.when(i == whole - 1, duration).otherwise((i + 1) * size).alias("end")))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def state_family(verb: Column) -> Column:
    """What kind of state an action's verb changes."""
    return F.when(verb.isin("Open", "Close"), "openable").when(verb.isin("SwitchOn", "SwitchOff"), "switchable").otherwise("portable")


def state_answers(verb: Column) -> Column:
    """The answers that a question on the state after a verb offers."""
    offered = {
        "openable": ("Fully closed.", "Fully open.", "Partly open."), "switchable": ("On.", "Off.", "Being switched between on and off."),
        "portable": ("Held by a person.", "Resting on a surface.", "Lying on the floor."),
    }
    own = F.create_map(*[x for k, v in offered.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return own[state_family(verb)]


def event_labels(kind: Column, action: Column, toggled_on: Column) -> Column:
    """(family, action) of an event's type; an unknown type is an error."""
    pair = lambda f, a: F.struct(F.lit(f).alias("family"), a.alias("action"))
    changed = F.when(action == "toggle", F.when(F.coalesce(toggled_on, F.lit(True)), "toggle_on").otherwise("toggle_off")).otherwise(F.coalesce(action, F.lit("slice")))
    return (
        F.when(kind == "move", pair("movement", F.lit("move")))
        .when(kind.isin("appear", "disappear"), pair("presence_change", kind))
        .when(kind.isin("occlude", "reveal"), pair("occlusion", kind))
        .when(kind == "state_change", pair("state_change", changed))
        .when(kind == "identity_swap", pair("identity_swap", F.coalesce(action, F.lit("swap_positions"))))
        .when(kind == "quantity_change", pair("quantity_change", F.coalesce(action, F.lit("add_instance"))))
        .when(kind == "no_change", pair("no_change", F.lit("none")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce(kind, F.lit("null")))).cast("struct<family:string,action:string>"))
    )


def boundary(value: Column, allowed: Column, tolerance: float = 0.05) -> Column:
    """The nearest allowed boundary (the first of equally near ones); farther than the tolerance is an error."""
    near = F.array_min(F.transform(allowed, lambda x, k: F.struct(F.abs(x - value).alias("gap"), k.alias("k"), x.alias("at"))))
    return F.when(near["gap"] <= tolerance, near["at"]).otherwise(F.raise_error(F.concat(value.cast("string"), F.lit(" is not aligned to a boundary"))))
