"""Chat formatting: turn-aligned windows under a token budget, with repeated history and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.plans.frames import attach, written

#: A turn is `<|role|>\n` text `<|end|>\n`. A backslash goes into every control string of a text or role.
_CONTROL = r"<(?=\||s>|/s>)|\|(?=>)|\[(?=/?INST\])"
_TURN = r"(?s)<\|([^|]*(?:\|(?!>)[^|]*)*)\|>\n(.*?)<\|end\|>\n"
_TAIL = "<|end|>\n"


def escape(text: Column) -> Column:
    """Doubles backslashes, then breaks `<|`, `|>`, `<s>`, `</s>`, `[INST]` and `[/INST]` with one."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def token_estimate(text: Column) -> Column:
    """About one token per four characters, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def _running(turns: DataFrame, block: int) -> DataFrame:
    """Adds `before`, the tokens of all earlier turns of the conversation, and `lead`, those of its system turn (0 without).

    Sums of blocks of `block` turn numbers come first, so a conversation of any length is spread over tasks.
    """
    turns = turns.withColumn("__block", F.floor(F.col("turn") / block))
    keys = ["conv_id", "__block"]
    inner = W.partitionBy(*keys).orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy("conv_id").orderBy("__block")
    sums = turns.groupBy(*keys).agg(F.sum("tokens").alias("s"), F.min(F.struct("turn", "role", "text", "tokens")).alias("top"))
    sums = sums.withColumn("top", F.when(F.col("top.role") == "system", F.col("top.tokens")).otherwise(0))
    sums = sums.withColumn("base", F.coalesce(F.sum("s").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("lead", F.first("top").over(over.rowsBetween(W.unboundedPreceding, 0)))
    turns = turns.withColumn("before", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    joined = attach(turns, sums.select(*keys, "base", "lead"), keys, "inner")
    return joined.withColumn("before", F.col("before") + F.col("base")).drop("__block", "base")


def place_turns(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Adds `window`, in the order of the turns, from prefix sums alone.

    `body` is the budget without history and system turn, at least half of what history leaves. With b tokens before it, a turn
    belongs to the stretch b div (3/4 body). Turns that end within `body` tokens of their stretch's start share its window
    (an even number); one that ends later, always the last of its stretch, has the odd window after it for itself.
    """
    body = F.greatest(F.lit(budget - history) - F.col("lead"), F.lit((budget - history) // 2))
    turns = turns.withColumn("body", body).withColumn("width", F.expr("body - body div 4"))
    turns = turns.withColumn("stretch", F.expr("before div width"))
    late = F.col("before") + F.col("tokens") > F.col("stretch") * F.col("width") + F.col("body")
    return turns.withColumn("window", 2 * F.col("stretch") + late.cast("long")).drop("body")


def repeated_turns(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv_id, before, window): the earlier turns that a window repeats, on rows without texts.

    What a window's own turns leave of the budget goes to the system turn, if it fits, then to history: those turns that
    lie whole within the last `history` tokens, or what is left, before the window's first own turn.
    """
    narrow = placed.select("conv_id", "before", "tokens", "role", "width", "stretch", "window", "lead")
    windows = narrow.groupBy("conv_id", "window").agg(F.min("before").alias("first"), F.sum("tokens").alias("own"), F.max("lead").alias("lead"))
    windows = windows.withColumn("room", F.lit(budget) - F.col("own"))
    leads = (F.col("first") > 0) & (F.col("lead") > 0) & (F.col("lead") <= F.col("room"))
    windows = windows.withColumn("leads", leads).withColumn("reach", F.least(F.lit(history), F.col("room") - F.when(leads, F.col("lead")).otherwise(0)))
    is_lead = (F.col("before") == 0) & (F.col("lead") > 0)
    # a window that can see a turn starts in one of the stretches that its last `history` tokens touch
    last = F.floor((F.col("before") + history) / F.col("width"))
    spots = F.flatten(F.transform(F.sequence("stretch", last), lambda k: F.array(2 * k, 2 * k + 1)))
    seen = narrow.where(~is_lead & (F.col("tokens") <= history)).select(
        "conv_id", "before", (F.col("before") + F.col("tokens")).alias("until"), F.col("window").alias("mine"), F.explode(spots).alias("window")
    )
    seen = attach(seen.where("window > mine"), windows.select("conv_id", "window", "first", "reach"), ["conv_id", "window"], "inner")
    seen = seen.where("before >= first - reach AND until <= first").select("conv_id", "before", "window")
    first = F.lit(0).cast("long").alias("before")
    return seen.unionByName(windows.where("leads").select("conv_id", first, "window"))


def chat_windows(conversations: DataFrame, budget: int = 1024, history: int = 128, block: int = 256) -> DataFrame:
    """One row per training window: conv_id, window, formatted, n_repeated, loss_spans, tokens.

    Turns are ordered by (turn, role, text) and dealt to windows by their prefix sums (`place_turns`). A window starts with
    the conversation's system turn, if its first turn is one, and with the last turns before it (`repeated_turns`).
    These `n_repeated` turns carry no loss; the window's own assistant turns do, each in exactly one window.
    `loss_spans` are (start, end) in code points of `formatted`, on the escaped text. Window numbers grow with the
    turns and have gaps.

    No window has more than `budget` tokens, system and repeated turns included, but one: a turn that is longer by itself
    stands alone in its window, uncut. A system turn is left out of windows whose own turns leave no room for it. A history
    as long as the budget, or a negative one, is refused.

    Null texts and roles are empty, a null turn number sorts first, rows of a null conv_id form one
    conversation, repeated rows are turns of their own; other columns are ignored. An empty table gives no rows.
    """
    if not 0 <= history <= budget - 2:
        raise ValueError(f"history of {history} tokens in a budget of {budget}")
    turns = conversations.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = turns.withColumn("piece", escape(F.col("text"))).withColumn("head", F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")))
    turns = _running(turns.withColumn("tokens", token_estimate(F.concat("head", "piece"))), block).drop("text")
    placed = written(place_turns(turns, budget, history))
    # every turn has a token at least, so `before` names it within its conversation
    texts = placed.select("conv_id", "before", "turn", "role", "head", "piece", "tokens")
    again = attach(repeated_turns(placed, budget, history), texts, ["conv_id", "before"], "inner").withColumn("again", F.lit(True))
    copies = placed.select(*texts.columns, "window", F.lit(False).alias("again")).unionByName(again)
    piece = F.struct("before", "turn", "role", "again", "head", "piece", "tokens")
    rows = copies.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        end = begin + F.length(t["piece"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when((t["role"] == "assistant") & ~t["again"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + len(_TAIL)).alias("at"), spans.alias("spans"))

    return rows.select(
        "conv_id", "window",
        F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["piece"], F.lit(_TAIL)))).alias("formatted"),
        F.size(F.filter("turns", lambda t: t["again"])).alias("n_repeated"),
        F.aggregate("turns", start, step)["spans"].alias("loss_spans"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["tokens"]).alias("tokens"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Reads formatted windows back, one row per window: its own turns as (role, text), and the loss texts."""
    roles = F.regexp_extract_all("formatted", F.lit(_TURN), 1)
    texts = F.regexp_extract_all("formatted", F.lit(_TURN), 2)
    turns = F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select(
        "conv_id", "window", "formatted",
        F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.lit(1), F.size(roles))).alias("turns"),
        F.concat_ws("", loss).alias("loss_text"),
    )
