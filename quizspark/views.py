"""The test tables seen as the entities of the library.

Every view is a projection, or one join, over whole tables; nothing is filtered or cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quizspark.functions.labels import difficulty_level
from quizspark.operators.catalog import normalize_catalog
from quizspark.plans.spread import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as questions: name as text and answer, brand as category, size as value."""
    value = (F.col("p_size") * 50).cast("int")
    third = F.pmod(F.col("p_partkey"), F.lit(3))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("question_id"), F.col("p_name").alias("question"),
        F.concat(F.lit("What is "), F.col("p_name"), F.lit("?")).alias("answer"),
        F.col("p_brand").alias("category"), F.col("p_type").alias("topic"), value.alias("value"),
        difficulty_level(value).alias("difficulty_level"),
        F.date_add(F.lit("1984-09-10").cast("date"), F.pmod(F.col("p_partkey"), F.lit(12000)).cast("int"))
        .alias("air_date"),
        F.pmod(F.col("p_partkey"), F.lit(4000)).cast("int").alias("show_number"),
        F.when(third == 0, "Jeopardy!").when(third == 1, "Double Jeopardy!").otherwise("Final Jeopardy!")
        .alias("round"))


def raw_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as an uncleaned question set under synonym column names, all text."""
    pid = F.col("page_id")
    fifth = F.pmod(pid, F.lit(5))
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(pid, F.lit(9000)).cast("int"))
    return table(spark, sf_dir, "pages").select(
        pid.cast("string").alias("page"), F.col("html").alias("Clue"), F.col("url").alias("Response"),
        F.concat(F.lit("  topic &amp; "), F.pmod(pid, F.lit(7)).cast("string")).alias("Subject"),
        F.when(fifth == 0, F.concat(F.lit("$"), (pid * 10).cast("string")))
        .when(fifth == 1, F.lit("None")).when(fifth == 2, F.concat(pid.cast("string"), F.lit(".0")))
        .when(fifth == 3, F.lit("$1,200")).otherwise((pid * 7).cast("string")).alias("Worth"),
        F.when(fifth == 0, F.date_format(day, "yyyy-MM-dd")).when(fifth == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(fifth == 2, F.lit("invalid-date")).when(fifth == 3, F.date_format(day, "MMMM d, yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss")).alias("Date"))


def results(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    """Line items as graded answers of three models in one run per supplier; dealt to all cores if asked."""
    lines = table(spark, sf_dir, "lineitem")
    if spread_out:
        lines = spread(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount", "l_quantity",
                                    "l_tax"))
    line = F.col("l_linenumber")
    correct = F.when((F.col("l_linestatus") == "O") & (line == 7), F.lit(None).cast("boolean")).otherwise(
        F.col("l_discount") < 0.05)
    out_tokens = F.col("l_quantity").cast("bigint")
    in_tokens = (line * 25).cast("bigint")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("result_id"),
        F.col("l_suppkey").alias("run_id"), F.col("l_partkey").alias("question_id"),
        F.concat(F.lit("model-"), F.col("l_returnflag")).alias("model_name"), correct.alias("is_correct"),
        (1 - F.col("l_discount")).alias("confidence"), (F.col("l_quantity") * 40).cast("int").alias("latency_ms"),
        F.col("l_tax").cast("decimal(10,6)").alias("cost_usd"), (in_tokens + out_tokens).alias("tokens_used"),
        in_tokens.alias("tokens_input"), out_tokens.alias("tokens_output"),
        (F.col("l_quantity") >= 49).alias("is_timeout"), (F.col("l_discount") >= 0.10).alias("is_error"),
        line.alias("attempt"),
        F.when(line <= 2, "jeopardy_format").when(line <= 4, "direct_answer").when(line == 5, "refusal")
        .when(line == 6, "uncertain").otherwise("explanation").alias("response_type"),
        F.when(line <= 3, "exact").when(line <= 5, "fuzzy").otherwise("semantic").alias("match_type"))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with category, difficulty and value of their question."""
    q = questions(spark, sf_dir).select("question_id", "category", "difficulty_level", "value")
    return results(spark, sf_dir).join(q, "question_id")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text answers written from the question's answer, in seven styles by attempt."""
    q = questions(spark, sf_dir).select("question_id", "question", "answer", "category", "difficulty_level", "value")
    name, line = F.col("question"), F.col("attempt")
    near = F.concat(F.substring(name, 1, 3), F.substr(name, F.lit(5)))
    text = (F.when(line == 1, F.concat(F.lit("What is "), name, F.lit("?")))
            .when(line == 2, F.concat(F.lit("Answer:  the "), F.upper(name), F.lit(".")))
            .when(line == 3, F.concat(F.lit("I think it is "), name, F.lit(". Probably.")))
            .when(line == 4, F.concat(name, F.lit(" because the clue says so")))
            .when(line == 5, F.lit("I don't know the answer."))
            .when(line == 6, F.concat(F.lit("The answer is: who is "), near, F.lit("! Certain")))
            .otherwise(F.when(F.pmod(F.col("question_id"), F.lit(4)) == 0, F.lit("  "))
                       .otherwise(F.concat(F.lit("This is five "), near))))
    return results(spark, sf_dir, spread_out=True).join(q, "question_id").withColumn("response_text", text)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of seven models."""
    cust = F.col("o_custkey")
    model = F.concat(F.lit("model-"), F.pmod(cust, F.lit(7)).cast("string"))
    other = F.concat(F.lit("model-"), F.pmod(cust, F.lit(5)).cast("string"))
    planned = (F.lit(50) + F.pmod(cust, F.lit(150))).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("run "), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running")
        .otherwise("pending").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
        planned.alias("sample_size"), F.lower(F.substr("o_orderpriority", F.lit(3))).alias("benchmark_mode"),
        F.when(F.pmod(cust, F.lit(3)) == 0, model)
        .otherwise(F.concat(F.lit('["'), model, F.lit('","'), other, F.lit('"]'))).alias("models_tested"),
        planned.alias("total_questions"),
        F.when(F.col("o_orderstatus") == "F", planned).when(F.col("o_orderstatus") == "O", (planned / 2).cast("int"))
        .otherwise(F.lit(0)).alias("completed_questions"),
        F.when(F.pmod(cust, F.lit(9)) > 0, (F.col("o_totalprice") / 10000).cast("decimal(10,6)"))
        .alias("total_cost_usd"),
        F.when(F.pmod(cust, F.lit(8)) > 0, cust * 10).alias("total_tokens"),
        F.when(F.pmod(cust, F.lit(13)) > 0, F.col("o_totalprice") / 250).alias("avg_response_time_ms"))


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One performance row per run."""
    cust = F.col("o_custkey")
    planned = (F.lit(50) + F.pmod(cust, F.lit(150))).cast("int")
    price = F.col("o_totalprice")
    whole = F.floor(price)
    acc = F.when(F.pmod(cust, F.lit(11)) > 0, F.pmod(whole, F.lit(10001)) / 10000.0)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("model-"), F.pmod(cust, F.lit(7)).cast("string")).alias("model_name"),
        planned.alias("total_questions"), F.floor(planned * F.coalesce(acc, F.lit(0.0))).alias("correct_answers"),
        acc.alias("accuracy_rate"),
        F.when(F.pmod(cust, F.lit(17)) > 0, F.pmod(whole, F.lit(20001)) - 10000)
        .alias("signed_score"),
        F.when(F.pmod(cust, F.lit(13)) > 0, price / 250).alias("avg_response_time_ms"),
        F.when(F.pmod(cust, F.lit(9)) > 0, F.when(F.pmod(cust, F.lit(4)) == 0, 0.0)
               .otherwise(price / 100000)).alias("total_cost_usd"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a usage and request log; the event type decides the model."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), usage_model(kind).alias("model_id"),
        F.col("user_id").cast("string").alias("session_id"), (k * 10).alias("input_tokens"),
        k.alias("output_tokens"), F.col("value").alias("cost"), (kind == "error").alias("is_error"))


def usage_model(kind: Column) -> Column:
    return (F.when(kind == "click", "openai/gpt-4").when(kind == "view", "anthropic/claude-sonnet")
            .when(kind == "purchase", "meta-llama/llama-2-70b-chat").when(kind == "signup", "lab/unlisted")
            .otherwise("google/palm-2-chat"))


def api_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a provider's model list, with prices in both units."""
    key, size = F.col("p_partkey"), F.col("p_size")
    fourth = F.pmod(key, F.lit(4))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"),
                 key.cast("string")).alias("model_id"),
        F.when(fourth > 0, F.initcap("p_name")).alias("name"), (size * 4096).cast("int").alias("context_length"),
        F.when(fourth == 0, F.lit(0.0)).when(fourth == 1, F.col("p_retailprice") / 1e9)
        .otherwise(F.col("p_retailprice") / 100).alias("prompt_price"),
        F.when(fourth == 0, F.lit(0.0)).when(fourth == 1, F.col("p_retailprice") / 5e8)
        .otherwise(F.col("p_retailprice") / 50).alias("completion_price"),
        F.when(fourth == 0, size / 10).alias("listed_input_cost"),
        F.when(fourth == 0, size / 5).alias("listed_output_cost"),
        (F.pmod(size, F.lit(3)) > 0).alias("supports_streaming"), (F.pmod(size, F.lit(5)) == 0).alias("supports_vision"),
        (F.pmod(key, F.lit(10)) == 0).alias("disabled"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_catalog(api_catalog(spark, sf_dir))
