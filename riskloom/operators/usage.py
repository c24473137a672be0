"""Token usage and cost of model responses kept as JSON text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Price per million tokens (input, output) and per tool call, in dollars.
TOKEN_PRICES = {
    "gpt-4.1": (2.0, 8.0),
    "gpt-5": (1.25, 10.0),
    "gpt-5.1": (1.25, 10.0),
    "gpt-5.2": (1.75, 14.0),
    "gpt-5-mini": (0.25, 2.0),
    "gpt-5-nano": (0.05, 0.40),
}
TOOL_PRICES = {"web_search": 0.01, "web_search_preview": 0.01, "file_search": 0.0025}

_USAGE = "struct<input_tokens:bigint,prompt_tokens:bigint,output_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
_CALLS = (
    "struct<tool_calls:array<struct<name:string,type:string>>,"
    "output:array<struct<type:string,content:array<struct<type:string>>>>>"
)


def tokens(body: Column, path: str = "$.usage") -> Column:
    """struct(input_tokens, output_tokens, total_tokens) from response JSON, NULL without usage."""
    return _token_counts(F.from_json(F.get_json_object(body, path), _USAGE))


def _token_counts(u: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    inp = F.coalesce(F.nullif(u["input_tokens"], zero), u["prompt_tokens"], zero)
    out = F.coalesce(F.nullif(u["output_tokens"], zero), u["completion_tokens"], zero)
    total = F.coalesce(F.nullif(u["total_tokens"], zero), inp + out)
    return F.when(
        u.isNotNull(), F.struct(inp.alias("input_tokens"), out.alias("output_tokens"), total.alias("total_tokens"))
    )


def _call_name(kind: Column) -> Column:
    return F.when(kind.endswith("_call"), F.regexp_replace(kind, "_call$", ""))


def tool_names(body: Column) -> Column:
    """Names of all tool calls of a response, one entry per call.

    Direct `tool_calls` win; otherwise `output` items of type `<name>_call`, or such entries in
    the content of other items.
    """
    return _names(F.from_json(body, _CALLS))


def _names(parsed: Column) -> Column:
    direct = F.transform(parsed["tool_calls"], lambda c: F.coalesce(F.nullif(c["name"], F.lit("")), _call_name(c["type"])))
    nested = F.flatten(
        F.transform(
            parsed["output"],
            lambda item: F.when(item["type"].endswith("_call"), F.array(_call_name(item["type"]))).otherwise(
                F.transform(F.coalesce(item["content"], F.array().cast("array<struct<type:string>>")), lambda e: _call_name(e["type"]))
            ),
        )
    )
    names = F.when(F.size(parsed["tool_calls"]) > 0, direct).otherwise(nested)
    return F.coalesce(F.array_compact(names), F.array().cast("array<string>"))


def count_names(names: Column) -> Column:
    """map(name -> count) of one response's calls."""
    return F.map_from_entries(
        F.transform(
            F.array_distinct(names),
            lambda n: F.struct(n.alias("key"), F.size(F.filter(names, lambda x: x == n)).cast("bigint").alias("value")),
        )
    )


def token_cost(
    model: Column, input_tokens: Column, output_tokens: Column,
    prices: Mapping[str, tuple[float, float]] = TOKEN_PRICES, compat: bool = False, digits: int = 6,
) -> Column:
    """Dollars of a call; exact model name first, then the longest matching prefix.

    `compat=True` takes the first prefix in table order. An unknown model has no cost.
    """

    def cost(price: tuple[float, float]) -> Column:
        return input_tokens / 1_000_000 * F.lit(float(price[0])) + output_tokens / 1_000_000 * F.lit(float(price[1]))

    prefixes = list(prices) if compat else sorted(prices, key=lambda n: (-len(n), n))
    out = F
    for name in prices:
        out = out.when(model == name, cost(prices[name]))
    for name in prefixes:
        out = out.when(model.startswith(name), cost(prices[name]))
    return F.round(out, digits)


def tool_cost(counts: Column, prices: Mapping[str, float] = TOOL_PRICES) -> Column:
    """Dollars of the counted tool calls; tools without a price are free."""
    total = F.lit(0.0)
    for name, price in prices.items():
        total = total + F.coalesce(counts[name], F.lit(0)) * F.lit(float(price))
    return F.round(total, 6)


def with_usage(df: DataFrame, body: str, model: str = "model", compat: bool = False, digits: int = 6) -> DataFrame:
    """Usage columns of every response; responses without usage have NULLs."""
    usage = F.from_json(F.get_json_object(body, "$.usage"), _USAGE)
    parsed = df.withColumns({"__usage": usage, "__calls": F.from_json(body, _CALLS)})  # parsed once, used many times
    parsed = parsed.withColumns({"__u": _token_counts(F.col("__usage")), "__names": _names(F.col("__calls"))})
    rows = parsed.withColumn("tool_calls", count_names(F.col("__names")))
    cost = token_cost(F.col(model), F.col("__u.input_tokens"), F.col("__u.output_tokens"), compat=compat, digits=digits)
    rows = rows.withColumns({"token_cost_usd": cost, "tool_cost_usd": tool_cost(F.col("tool_calls"))})
    return rows.select(
        *df.columns, "__u.input_tokens", "__u.output_tokens", "__u.total_tokens", "token_cost_usd", "tool_calls", "tool_cost_usd",
        (F.coalesce("token_cost_usd", F.lit(0.0)) + F.col("tool_cost_usd")).alias("cost_usd"),
    )


def tool_call_counts(df: DataFrame, body: str) -> DataFrame:
    """(tool, calls) over all responses."""
    return df.select(F.explode(tool_names(F.col(body))).alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"))


def batch_cost(
    df: DataFrame, model: str, status: str = "status_code", body: str = "body", discount: float | None = None
) -> DataFrame:
    """One usage row for all successful lines of a batch; the discount applies to token cost only."""
    good = df.where(F.col(status) == 200).select(F.col(body).alias("body"))
    inner = F.coalesce(F.get_json_object("body", "$.response"), F.col("body"))
    used = good.select(F.coalesce(tokens(F.col("body")), tokens(F.col("body"), "$.response.usage")).alias("u"), tool_names(inner).alias("names"))
    zero = F.lit(0)
    def calls_of(name: str) -> Column:
        return F.sum(F.size(F.filter("names", lambda x: x == name)))

    priced = [calls_of(n).alias(f"__t{i}") for i, n in enumerate(TOOL_PRICES)]
    total = used.agg(
        F.coalesce(F.sum("u.input_tokens"), zero).alias("input_tokens"), F.coalesce(F.sum("u.output_tokens"), zero).alias("output_tokens"),
        F.sum(F.size("names")).alias("calls"), *priced,
    )
    cost = token_cost(F.lit(model), F.col("input_tokens"), F.col("output_tokens"))
    if discount is not None:
        cost = F.round(cost * F.lit(float(discount)), 6)
    tools = F.round(sum((F.coalesce(F.col(f"__t{i}"), zero) * F.lit(float(p)) for i, p in enumerate(TOOL_PRICES.values())), F.lit(0.0)), 6)
    return total.select(
        F.lit(model).alias("model"), "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        cost.alias("token_cost_usd"), F.coalesce("calls", zero).alias("tool_calls"), tools.alias("tool_cost_usd"),
        (F.coalesce(cost, F.lit(0.0)) + tools).alias("cost_usd"),
    )
