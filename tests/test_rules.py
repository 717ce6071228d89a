"""Positives, negatives, offsets and prefilters of the rule catalogue."""

import re

import pytest
from pyspark.sql import functions as F

from tracewright.functions import rules
from tracewright.operators import scan

SPANS = "trace_id string, ord int, idx string, text string, agent string, kind string, parent string"

#: (text, failure types that must be found)
POSITIVE = [
    ("status_code: 401 from the model host", {"provider_unauthorized"}),
    ("Invalid API key provided", {"provider_invalid_api_key"}),
    ("the api key has expired", {"provider_expired_api_key"}),
    ("that api key was revoked", {"provider_revoked_api_key"}),
    ("error code: 403 for this key", {"provider_forbidden"}),
    ("an expired token was sent", {"provider_invalid_token"}),
    ("missing api key in the header", {"provider_missing_credential"}),
    ("openai: 429 too many requests", {"provider_rate_limit"}),
    ("You exceeded your current quota, check the plan", {"provider_quota_exceeded"}),
    ("tokens per minute limit exceeded", {"provider_tpm_exceeded"}),
    ("requests per minute cap exceeded", {"provider_rpm_exceeded"}),
    ("402 payment required", {"provider_payment_required"}),
    ("insufficient balance left", {"provider_insufficient_balance"}),
    ("billing hard limit is near", {"provider_billing_hard_limit"}),
    ("your credits are exhausted", {"provider_credits_exhausted"}),
    ("the account was suspended for billing", {"provider_account_suspended"}),
    ("The model `zeta-1` does not exist", {"provider_model_not_found"}),
    ("model 'zeta-1' has been deprecated", {"provider_model_deprecated"}),
    ("the model is unavailable in your region", {"provider_model_unavailable"}),
    ("that model is not enabled", {"provider_model_not_enabled"}),
    ("unsupported model name", {"provider_unsupported_model"}),
    ("it lacks support for any such model", {"provider_model_incompatible"}),
    ("failed to validate gpt-9x", {"provider_model_validation_failed"}),
    ("maximum context length is 8192", {"provider_context_length_exceeded"}),
    ("the prompt is too long", {"provider_input_too_long"}),
    ('finish_reason: "length"', {"provider_output_truncated"}),
    ("max_completion_tokens was exceeded", {"provider_max_completion_tokens_exceeded"}),
    ("context overflow", {"provider_context_overflow"}),
    ("token limit reached", {"provider_token_limit_exceeded"}),
    ("JSONDecodeError: Expecting value: line 1 column 1 (char 0)", {"provider_invalid_json"}),
    ("KeyError: 'choices'", {"provider_missing_choices"}),
    ("UnexpectedModelBehavior in step", {"provider_unexpected_structure"}),
    ("streaming aborted", {"provider_stream_interrupted"}),
    ("could not parse the response", {"provider_response_deserialization_error"}),
    ("failed to parse tool arguments", {"tool_invalid_arguments_json"}),
    ("schema validation failed here", {"tool_schema_validation_error"}),
    ("argument depth expected int, got str", {"tool_argument_type_error"}),
    ("null given for the parameter, list expected", {"tool_null_parameter"}),
    ("AttributeError: 'NoneType' object", {"tool_call_type_error"}),
    ("Traceback\nKeyError: 'row'", {"tool_call_runtime_error"}),
    ("it returned None instead of rows", {"tool_unexpected_none"}),
    ('{"success": false}', {"tool_returned_error"}),
    ("'path' is a required property", {"tool_missing_required_argument"}),
    ("call failed: missing required field", {"tool_missing_required_argument"}),
    ("f() got an unexpected keyword argument 'x'", {"tool_unexpected_argument"}),
    ("tool fetch_rows is not registered", {"tool_not_found"}),
    ("that function is not callable", {"tool_not_callable"}),
    ("NotImplementedError: later", {"tool_not_implemented"}),
    ("could not decode the model output", {"output_expected_json"}),
    ("error: expected valid JSON", {"output_expected_json"}),
    ("output format violation", {"output_format_violation"}),
    ("failed to deserialize the tool output", {"output_deserialization_error"}),
    ('{"a": 1, "b"', {"tool_output_invalid_json"}),
    ("bad request", {"api_malformed_request"}),
    ("authentication failed", {"api_auth_error"}),
    ("HTTP 404", {"api_not_found"}),
    ("the request timed out", {"api_request_timeout"}),
    ("409 conflict", {"api_conflict"}),
    ("too many requests", {"api_rate_limit"}),
    ("502: bad gateway", {"api_server_error"}),
    ("the response is empty", {"api_empty_response"}),
    ("output = {}", {"api_empty_response"}),
    ("connection refused", {"api_network_failure"}),
    ("getaddrinfo failed", {"api_network_failure"}),
    ("environment variable HOME_X not set", {"env_missing_variable"}),
    ("credentials not configured", {"env_missing_credential"}),
    ("invalid yaml", {"config_invalid_yaml"}),
    ("json syntax error", {"config_invalid_json"}),
    ("missing required config key", {"config_missing_field"}),
    ("ModuleNotFoundError: No module named 'zeta'", {"env_dependency_error"}),
    ("[Errno 13] on disk", {"env_permission_error"}),
    ("Traceback (most recent call last):\nFileNotFoundError: zeta.csv", {"env_file_not_found"}),
]
NEGATIVE = [
    ("there were 429 apples in the hall", "provider_rate_limit"),
    ("our rate limit exceeded all hopes", "provider_rate_limit"),
    ("a fashion model walked by", "provider_model_not_found"),
    ("raise ValueError: x", "tool_call_runtime_error"),
    ("except KeyError: y", "tool_call_runtime_error"),
    ("Raises TypeError if it is wrong", "tool_call_type_error"),
    ('{"a": 1}', "tool_output_invalid_json"),
    ('{"a": 1} and more', "tool_output_invalid_json"),
    ("plain words", "tool_output_invalid_json"),
    ("return the expected json", "output_expected_json"),
    ("each record is missing a required field", "tool_missing_required_argument"),
    ("I have not found the answer", "api_not_found"),
    ("3 validation errors for ChatCompletion", "tool_schema_validation_error"),
    ("status 41.429 of 500", "api_rate_limit"),
]


def found(spark, texts, **options):
    rows = [("t", i, str(i), t, "a", None, None) for i, t in enumerate(texts)]
    got = {}
    for r in scan.scan(spark.createDataFrame(rows, SPANS), suppress=False, **options).collect():
        got.setdefault(int(r["idx"]), []).append(r)
    return got


def test_the_catalogue_is_whole():
    assert rules.n_rules() == 89 and len(rules.CHECKS) == 20
    types = {r[1] for *_, rows in rules.CHECKS for r in rows}
    assert len(types) == 68
    assert types == set().union(*(t for _, t in POSITIVE))


def test_positives_and_negatives(spark):
    got = found(spark, [t for t, _ in POSITIVE] + [t for t, _ in NEGATIVE])
    for i, (text, types) in enumerate(POSITIVE):
        assert types <= {r["failure_type"] for r in got.get(i, [])}, text
    for i, (text, failure) in enumerate(NEGATIVE, len(POSITIVE)):
        assert failure not in {r["failure_type"] for r in got.get(i, [])}, text


def test_every_rule_fires_within_its_needles():
    """Python's engine tries the rules on all examples: what a rule matches holds one of the strings that it needs."""
    for text, _ in POSITIVE + NEGATIVE:
        for _, _, _, rows in rules.CHECKS:
            for pattern, _, _ in rows:
                if pattern and re.search(pattern, text, re.IGNORECASE):
                    assert any(x in text.lower() for x in rules.needles(pattern) or [""]), (pattern, text)


def test_needles():
    assert rules.needles(r"(?:ab|cde)+x?\bfgh[ij]k") == {"fgh"}
    assert rules.needles(r"a*|b") is None and rules.needles(r"(?<!no )Yes\b\s*(one|two)") in ({"yes"}, {"one", "two"})


def test_any_of_finds_what_an_alternation_finds():
    words = frozenset(["abc", "abd", "a.b", "b", "error", "err"])
    for text in ("xabd", "a.b", "axb", "aac", "erorr", "er err", "ab", ""):
        assert bool(re.search(rules.any_of(words), text)) == any(w in text for w in words), text


def test_letters_that_match_without_regard_to_case_are_folded(spark):
    """A Kelvin sign, a long s and Turkish letters match k, s and i, so they must pass the plain search too."""
    texts = ["INVALID API_\u212aEY", "acce\u017fs denied", "permi\u017f\u017fion denied on a f\u0131le", "M\u0130SSING api key"]
    spans = spark.createDataFrame([("t", i, str(i), t, None, None, None) for i, t in enumerate(texts)], SPANS)
    low = spans.select(scan.folded(F.col("text"))).collect()
    for (x,), want in zip(low, ("api_key", "access", "permission denied on a file", "missing api key")):
        assert want in x


def test_offsets_agree_with_python(spark):
    texts = [f"\U0001f600 \U0001f680 é {t} \U0001f600" for t, _ in POSITIVE if not t.startswith("{")] + ["x" * 60_000 + " bad request", "y" * 49_988 + " bad request"]
    got = found(spark, texts)
    pattern = {(c, r): rows[r][0] for c, (*_, rows) in enumerate(rules.CHECKS) for r in range(len(rows))}
    n = 0
    for i, hits in got.items():
        text = texts[i][: rules.MAX_SPAN_TEXT]
        for h in hits:
            if h["m_start"] is not None:
                m = re.search(pattern[h["c"], h["r"]], text, re.IGNORECASE)
                assert (h["m_start"], h["m_end"]) == m.span()
                assert h["quote"] == text[max(0, m.start() - 80) : m.end() + 80]
                n += 1
    assert n > 70 and len(texts) - 2 not in got and len(texts) - 1 in got


def test_one_finding_a_span_for_api_checks(spark):
    got = found(spark, ["HTTP 404 and then HTTP 429"], checks=("api_status_code_validator",))
    assert [r["failure_type"] for r in got[0]] == ["api_not_found"]


def test_an_earlier_validator_keeps_an_overlapping_match_out(spark):
    df = spark.createDataFrame([("t", 0, "0", "error code: 401 unauthorized", None, None, None)], SPANS)
    kept = {(r["validator"], r["failure_type"]) for r in scan.scan(df).collect()}
    every = {(r["validator"], r["failure_type"]) for r in scan.scan(df, suppress=False).collect()}
    assert ("provider", "provider_unauthorized") in kept and ("api", "api_auth_error") in every - kept


@pytest.mark.parametrize(("failure", "want"), [("provider_rate_limit", "minor"), ("upstream_error", "major"), ("api_network_failure", "minor"), ("tool_not_found", "major"), ("provider_tpm_exceeded", "minor")])
def test_severity(spark, failure, want):
    from pyspark.sql import functions as F

    from tracewright.functions.text import severity

    assert spark.range(1).select(severity(F.lit(failure))).first()[0] == want


def test_empty_and_null_texts_have_no_findings(spark):
    assert found(spark, [None, "", "all is well"]) == {}
