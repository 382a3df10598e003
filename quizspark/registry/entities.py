"""The entity views of ``quizspark.views`` once more, as SQL for the comparison engine."""

CTES = {
    "questions": """
SELECT p_partkey AS question_id, p_name AS question, 'What is ' || p_name || '?' AS answer,
  p_brand AS category, p_type AS topic, CAST(p_size * 50 AS INT) AS value,
  CASE WHEN p_size * 50 <= 600 THEN 'Easy' WHEN p_size * 50 <= 1200 THEN 'Medium' ELSE 'Hard' END AS difficulty_level,
  DATE '1984-09-10' + CAST(p_partkey % 12000 AS INT) AS air_date, CAST(p_partkey % 4000 AS INT) AS show_number,
  CASE p_partkey % 3 WHEN 0 THEN 'Jeopardy!' WHEN 1 THEN 'Double Jeopardy!' ELSE 'Final Jeopardy!' END AS round
FROM part""",
    "raw_questions": """
SELECT CAST(page_id AS VARCHAR) AS page, html AS clue, url AS response,
  '  topic &amp; ' || CAST(page_id % 7 AS VARCHAR) AS subject,
  CASE page_id % 5 WHEN 0 THEN '$' || CAST(page_id * 10 AS VARCHAR) WHEN 1 THEN 'None'
    WHEN 2 THEN CAST(page_id AS VARCHAR) || '.0' WHEN 3 THEN '$1,200' ELSE CAST(page_id * 7 AS VARCHAR) END AS worth,
  CASE page_id % 5 WHEN 0 THEN strftime(DATE '1990-01-01' + CAST(page_id % 9000 AS INT), '%Y-%m-%d')
    WHEN 1 THEN strftime(DATE '1990-01-01' + CAST(page_id % 9000 AS INT), '%m/%d/%Y') WHEN 2 THEN 'invalid-date'
    WHEN 3 THEN strftime(DATE '1990-01-01' + CAST(page_id % 9000 AS INT), '%B %-d, %Y')
    ELSE strftime(DATE '1990-01-01' + CAST(page_id % 9000 AS INT), '%Y-%m-%d 00:00:00') END AS date_text
FROM pages""",
    "results": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS result_id, l_suppkey AS run_id,
  l_partkey AS question_id, 'model-' || l_returnflag AS model_name,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN NULL ELSE l_discount < CAST(0.05 AS DOUBLE) END AS is_correct,
  1 - l_discount AS confidence, CAST(l_quantity * 40 AS INT) AS latency_ms,
  CAST(l_tax AS DECIMAL(10,6)) AS cost_usd,
  CAST(l_linenumber * 25 AS BIGINT) + CAST(l_quantity AS BIGINT) AS tokens_used,
  CAST(l_linenumber * 25 AS BIGINT) AS tokens_input, CAST(l_quantity AS BIGINT) AS tokens_output,
  l_quantity >= 49 AS is_timeout, l_discount >= CAST(0.10 AS DOUBLE) AS is_error, l_linenumber AS attempt,
  CASE WHEN l_linenumber <= 2 THEN 'jeopardy_format' WHEN l_linenumber <= 4 THEN 'direct_answer'
    WHEN l_linenumber = 5 THEN 'refusal' WHEN l_linenumber = 6 THEN 'uncertain' ELSE 'explanation' END AS response_type,
  CASE WHEN l_linenumber <= 3 THEN 'exact' WHEN l_linenumber <= 5 THEN 'fuzzy' ELSE 'semantic' END AS match_type
FROM lineitem""",
    "graded": """
SELECT r.*, q.category, q.difficulty_level, q.value,
  CASE WHEN q.value < 400 THEN 'Low ($1-399)' WHEN q.value < 800 THEN 'Medium ($400-799)' ELSE 'High ($800+)' END AS value_bucket,
  CASE WHEN is_correct IS NULL THEN 0 WHEN is_correct THEN q.value ELSE -q.value END AS points
FROM results r JOIN questions q USING (question_id)""",
    "responses": """
SELECT r.*, q.question, q.answer, q.category, q.difficulty_level, q.value,
  CASE attempt WHEN 1 THEN 'What is ' || question || '?'
    WHEN 2 THEN 'Answer:  the ' || upper(question) || '.'
    WHEN 3 THEN 'I think it is ' || question || '. Probably.'
    WHEN 4 THEN question || ' because the clue says so'
    WHEN 5 THEN 'I don''t know the answer.'
    WHEN 6 THEN 'The answer is: who is ' || substr(question, 1, 3) || substr(question, 5) || '! Certain'
    ELSE CASE WHEN r.question_id % 4 = 0 THEN '  '
      ELSE 'This is five ' || substr(question, 1, 3) || substr(question, 5) END END AS response_text
FROM results r JOIN questions q USING (question_id)""",
    "runs": """
SELECT o_orderkey AS run_id, 'run ' || CAST(o_orderkey AS VARCHAR) AS name,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
  o_orderdate AS created_at, o_orderdate AS updated_at, CAST(50 + o_custkey % 150 AS INT) AS sample_size,
  lower(substr(o_orderpriority, 3)) AS benchmark_mode,
  CASE WHEN o_custkey % 3 = 0 THEN 'model-' || CAST(o_custkey % 7 AS VARCHAR)
    ELSE '["model-' || CAST(o_custkey % 7 AS VARCHAR) || '","model-' || CAST(o_custkey % 5 AS VARCHAR) || '"]' END AS models_tested,
  CAST(50 + o_custkey % 150 AS INT) AS total_questions,
  CASE o_orderstatus WHEN 'F' THEN 50 + o_custkey % 150 WHEN 'O' THEN (50 + o_custkey % 150) // 2 ELSE 0 END AS completed_questions,
  CASE WHEN o_custkey % 9 > 0 THEN CAST(o_totalprice / 10000 AS DECIMAL(10,6)) END AS total_cost_usd,
  CASE WHEN o_custkey % 8 > 0 THEN o_custkey * 10 END AS total_tokens,
  CASE WHEN o_custkey % 13 > 0 THEN o_totalprice / 250 END AS avg_response_time_ms
FROM orders""",
    "performance": """
SELECT o_orderkey AS run_id, 'model-' || CAST(o_custkey % 7 AS VARCHAR) AS model_name,
  CAST(50 + o_custkey % 150 AS INT) AS total_questions,
  CAST(floor((50 + o_custkey % 150) * CASE WHEN o_custkey % 11 > 0
    THEN (CAST(floor(o_totalprice) AS BIGINT) % 10001) / CAST(10000 AS DOUBLE) ELSE 0.0 END) AS BIGINT) AS correct_answers,
  CASE WHEN o_custkey % 11 > 0 THEN (CAST(floor(o_totalprice) AS BIGINT) % 10001) / CAST(10000 AS DOUBLE) END AS accuracy_rate,
  CASE WHEN o_custkey % 17 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 20001 - 10000 END AS signed_score,
  CASE WHEN o_custkey % 13 > 0 THEN o_totalprice / 250 END AS avg_response_time_ms,
  CASE WHEN o_custkey % 9 > 0 THEN CASE WHEN o_custkey % 4 = 0 THEN 0.0 ELSE o_totalprice / 100000 END END AS total_cost_usd
FROM orders""",
    "usage_log": """
SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'openai/gpt-4' WHEN 'view' THEN 'anthropic/claude-sonnet'
    WHEN 'purchase' THEN 'meta-llama/llama-2-70b-chat' WHEN 'signup' THEN 'lab/unlisted' ELSE 'google/palm-2-chat' END AS model_id,
  CAST(user_id AS VARCHAR) AS session_id,
  CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS input_tokens,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS output_tokens, value AS cost, event_type = 'error' AS is_error
FROM events""",
    "catalog": """
SELECT model_id, coalesce(nm, model_id) AS name, split_part(model_id, '/', 1) AS provider, context_length,
  CASE WHEN pin > 0 AND pin < 0.01 THEN pin * 1000000.0 ELSE pin END AS input_cost,
  CASE WHEN pout > 0 AND pout < 0.01 THEN pout * 1000000.0 ELSE pout END AS output_cost,
  [x FOR x IN [CASE WHEN streams THEN 'streaming' END, CASE WHEN sees THEN 'vision' END,
    CASE WHEN context_length >= 100000 THEN 'long_context' END, 'chat', 'reasoning'] IF x IS NOT NULL] AS capabilities,
  streams AS supports_streaming, NOT off AS available
FROM (SELECT lower(p_type) || '/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) AS model_id,
    CASE WHEN p_partkey % 4 > 0 THEN upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2)
      || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) END AS nm,
    CAST(p_size * 4096 AS INT) AS context_length,
    CASE p_partkey % 4 WHEN 0 THEN p_size / 10 WHEN 1 THEN p_retailprice / 1e9 ELSE p_retailprice / 100 END AS pin,
    CASE p_partkey % 4 WHEN 0 THEN p_size / 5 WHEN 1 THEN p_retailprice / 5e8 ELSE p_retailprice / 50 END AS pout,
    p_size % 3 > 0 AS streams, p_size % 5 = 0 AS sees, p_partkey % 10 = 0 AS off FROM part) AS parts""",
    "prices": """
SELECT * FROM (VALUES ('openai/gpt-3.5-turbo', 0.5, 1.5), ('openai/gpt-4', 30.0, 60.0), ('openai/gpt-4-turbo', 10.0, 30.0),
  ('anthropic/claude-3-haiku', 0.25, 1.25), ('anthropic/claude-3-sonnet', 3.0, 15.0), ('anthropic/claude-3.5-sonnet', 3.0, 15.0),
  ('anthropic/claude-sonnet-4', 3.0, 15.0), ('anthropic/claude-3-opus', 15.0, 75.0), ('meta-llama/llama-2-70b-chat', 0.7, 0.8),
  ('mistralai/mixtral-8x7b-instruct', 0.24, 0.24), ('google/palm-2-chat', 0.5, 0.5)) AS t(model_id, input_cost, output_cost)""",
}
