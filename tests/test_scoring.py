"""Batch protocol, default rules and qualified names."""

import random
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docloom.functions import qualified
from docloom.operators import scoring

# The scorers below run inside tasks, which cannot import a test module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def run(spark, n, scorer, size=4):
    rows = spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("text "), "id").alias("text"))
    return {r.key: r for r in scoring.score_entries(rows, scorer, size=size, max_parallel=2).collect()}


def answer(items, **changes):
    rows = [{"id": i["id"], "category": "added", "breaking": False, "breaking_reason": ""} for i in items]
    return {"stop_reason": "end_turn", "items": rows, **changes}


def test_all_scored(spark):
    found = run(spark, 10, scoring.keyword_scorer)
    assert len(found) == 10 and {r.status for r in found.values()} == {"ok"} and {r.attempts for r in found.values()} == {1}


def test_overflow_splits_once(spark):
    def scorer(items):
        return answer(items) if len(items) <= 2 else {"stop_reason": "max_tokens"}

    found = run(spark, 4, scorer)
    assert {r.status for r in found.values()} == {"ok"} and {r.attempts for r in found.values()} == {3}


def test_overflow_of_a_half_fails(spark):
    found = run(spark, 4, lambda items: {"stop_reason": "max_tokens"})
    assert [found[f"k{i}"].status for i in range(4)] == ["failed", "failed", "skipped", "skipped"]
    assert {r.attempts for r in found.values()} == {2}


def test_failed_second_half_keeps_the_first(spark):
    def scorer(items):
        if len(items) > 2:
            return {"stop_reason": "max_tokens"}
        return answer(items) if "text 0" in [i["text"] for i in items] else {"stop_reason": "refusal"}

    found = run(spark, 4, scorer)
    assert [found[f"k{i}"].status for i in range(4)] == ["ok", "ok", "failed", "failed"]
    assert found["k2"].reason == "refused"


def test_refused_first_half_leaves_the_second_unsent(spark):
    def scorer(items):
        return {"stop_reason": "max_tokens"} if len(items) > 2 else {"stop_reason": "refusal"}

    found = run(spark, 4, scorer)
    assert [found[f"k{i}"].status for i in range(4)] == ["failed", "failed", "skipped", "skipped"]
    assert {r.attempts for r in found.values()} == {2}


def test_unexpected_exception_keeps_other_batches(spark):
    def scorer(items):
        if "text 0" in [i["text"] for i in items]:
            raise KeyError("bug")
        return answer(items)

    found = run(spark, 8, scorer)
    assert [found[f"k{i}"].status for i in range(8)] == ["failed"] * 4 + ["ok"] * 4
    assert found["k0"].attempts == 1 and found["k0"].reason.startswith("KeyError")


def test_request_cap_is_applied_before_sending(spark):
    rows = spark.range(10).select(F.col("id").alias("ord"), F.concat(F.lit("k"), "id").alias("key"), F.lit("x").alias("text"))
    found = scoring.score_entries(rows, answer, size=4, max_requests=2, max_parallel=None).collect()
    assert {r.key for r in found if r.status == "ok"} == {f"k{i}" for i in range(8)}
    assert {(r.status, r.reason, r.attempts) for r in found if r.key in ("k8", "k9")} == {("skipped", "request cap reached", 0)}


def test_failure_stops_the_task(spark):
    rows = spark.range(8).select(F.col("id").alias("ord"), F.concat(F.lit("k"), "id").alias("key"), F.lit("x").alias("text"))
    found = scoring.score_entries(rows, lambda items: {"stop_reason": "refusal"}, size=4, max_parallel=1, stop_on_failure=True).collect()
    assert sorted(r.status for r in found) == ["failed"] * 4 + ["skipped"] * 4


def test_long_texts_are_whole_unless_shortened(spark):
    def scorer(items):
        reply = answer(items)
        reply["items"][0]["breaking_reason"] = str(len(items[0]["text"]))
        return reply

    rows = spark.createDataFrame([(1, "k", "x" * 20_000)], "ord long, key string, text string")
    assert scoring.score_entries(rows, scorer).first().breaking_reason == "20000"
    assert int(scoring.score_entries(rows, scorer, shorten=True).first().breaking_reason) < 10_000


def test_breaking_must_be_a_boolean(spark):
    def scorer(items):
        reply = answer(items)
        reply["items"][0]["breaking"] = "no"
        return reply

    assert {r.reason for r in run(spark, 2, scorer).values()} == {"invalid reply twice"}


@pytest.mark.parametrize("bad", ["missing", "unknown", "double", "category", "none"])
def test_invalid_reply_is_sent_again_then_fails(spark, bad):
    def scorer(items):
        reply = answer(items)
        rows = reply["items"]
        if bad == "missing":
            rows.pop()
        elif bad == "unknown":
            rows[0]["id"] = "zz"
        elif bad == "double":
            rows[0] = rows[1]
        elif bad == "category":
            rows[0]["category"] = "odd"
        else:
            reply["items"] = None
        return reply

    found = run(spark, 4, scorer)
    assert {(r.status, r.reason, r.attempts) for r in found.values()} == {("failed", "invalid reply twice", 2)}


def test_retryable_failures_are_tried_three_times(spark):
    def scorer(items):
        raise scoring.Retryable("overloaded")

    found = run(spark, 2, scorer)
    assert {(r.reason, r.attempts) for r in found.values()} == {("overloaded (after 3 attempts)", 3)}


def test_rules(spark):
    cases = {
        "Fixed a crash on close.": ("fixed", False),
        "Added a guard to avoid a race.": ("fixed", False),
        "Removed the deprecated spawn() function overloads.": ("deprecated", True),
        "Changed the default of the timeout.": ("changed", True),
        "Added support for pipes.": ("added", False),
        "Updated the documentation.": ("other", False),
        "Misc.": ("other", False),
    }
    rows = scoring.rule_scores(spark.createDataFrame([(t,) for t in cases], "text string")).collect()
    assert {r.text: (r.category, r.breaking) for r in rows} == cases
    assert [i["category"] for i in scoring.keyword_scorer([{"id": "e0", "text": t} for t in cases])["items"]] == [c for c, _ in cases.values()]


NAMES = {
    "ip::tcp::socket": ["ip", "tcp", "socket"],
    "x::operator bool": ["x", "operator bool"],
    'lits::operator"" _buf': ["lits", 'operator"" _buf'],
    "assoc< wrapper< T >, Allocator >::get": ["assoc< wrapper< T >, Allocator >", "get"],
    "a::~a": ["a", "~a"],
    "a::operator()": ["a", "operator()"],
    "a::operator<": ["a", "operator<"],
    "a::operator<<=": ["a", "operator<<="],
    "a::operator->": ["a", "operator->"],
    "a::operator std< T >": ["a", "operator std< T >"],
    "f< int(char) >": ["f< int(char) >"],
    "a :: b": ["a", "b"],
    "operators::x": ["operators", "x"],
    "Handler requirements": None,
    "ip::address >": None,
    "basic_socket::": None,
    "x::operator": None,
    "": None,
    "f< int": None,
    "1a": None,
}


# A plain scanner, to compare the fold with.
_SYMBOLS = "|".join(re.escape(s) for s in sorted(qualified.OPERATORS, key=len, reverse=True))
_HEAD = re.compile(
    rf"operator(?:\"\" *[A-Za-z_]\w*|(?P<symbol>{_SYMBOLS})| +[A-Za-z_]\w*(?P<conversion>))(?!\w)"
    r"|~?(?!operator\b)[A-Za-z_]\w*(?P<plain> *)"
)
_OPEN_CLOSE = re.compile(r"[<>()]")


def _after_brackets(text: str, at: int) -> int | None:
    """Position after the bracket group that opens at ``at``; None when it never closes."""
    depth = 0
    for found in _OPEN_CLOSE.finditer(text, at):
        depth += 1 if found.group() in "<(" else -1
        if depth == 0:
            return found.end()
    return None


def name_components(title: str) -> list[str] | None:
    """The ``::``-separated parts of a qualified name; None when the title is not one."""
    text, at, parts = " ".join(title.split()), 0, []
    while True:
        head = _HEAD.match(text, at)
        if head is None:
            return None
        end = head.end()
        takes_arguments = head.group("plain") is not None or head.group("conversion") is not None
        if takes_arguments and text[end : end + 1] == "<":
            end = _after_brackets(text, end)
            if end is None:
                return None
        parts.append(text[at:end].strip())
        rest = text[end:].lstrip(" ")
        if not rest:
            return parts
        if not rest.startswith("::"):
            return None
        at = len(text) - len(rest[2:].lstrip(" "))


def test_name_components():
    assert {title: name_components(title) for title in NAMES} == NAMES


def test_names_by_the_fold(spark):
    """Golden names, and random ones against the plain scanner."""
    rng = random.Random(7)
    bits = ["a", "b1", "_c", "9", "operator", "::", "<", ">", "(", ")", " ", "~", '""', "->", "==", "[]", "()", "&&", ",", "é", "bool", "<<"]
    titles = [*NAMES, "", " a ", "a ::b", "operator new", "operator bool<int>::x", "operator bool <int>", 'operator"" _x::y', "a<b<c>>::operator<<", "a<operator>>"]
    titles += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 7))) for _ in range(4000)]
    found = spark.createDataFrame([(t,) for t in titles], "title string").select("title", qualified.split_qualified(F.col("title")).alias("parts")).collect()
    assert [(r.title, r.parts) for r in found] == [(t, name_components(t)) for t in titles]
    assert sum(r.parts is not None for r in found) > 200


def test_names_need_no_python(spark, sf, capsys):
    scoring.name_index(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("title"))).explain()
    assert not any(x in capsys.readouterr().out for x in ("EvalPython", "InPandas", "InArrow"))


def test_name_index(spark):
    titles = spark.createDataFrame([("a::b::c",), ("a::b::c",), ("a::d",), ("not a name",)], "title string")
    assert {r.prefix: r.n_titles for r in scoring.name_index(titles).collect()} == {"a": 2, "a::b": 1, "a::b::c": 1, "a::d": 1}


# -- runs under caps


def waves(spark, n, scorer, caps, **options):
    rows = spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("text "), "id").alias("text"))
    found = scoring.score_in_waves(rows, scorer, caps, size=4, max_parallel=2, **options).collect()
    assert len(found) == n
    return {int(r.key[1:]): r for r in found}


ENOUGH = scoring.Caps(max_requests=1000, max_output=10**9, max_input=10**9)


def test_all_waves_are_sent_while_caps_allow(spark):
    found = waves(spark, 18, answer, ENOUGH, wave=2)
    assert {r.status for r in found.values()} == {"ok"} and {r.attempts for r in found.values()} == {1}


def test_an_overrun_stops_the_rest(spark):
    """Two waves of two batches; the third batch reports more than it reserved: its rows count, later ones are skipped."""

    def scorer(items):
        over = any(i["text"] == "text 9" for i in items)
        return answer(items, usage={"input_tokens": 10, "output_tokens": 10**7 if over else 5})

    found = waves(spark, 24, scorer, ENOUGH, wave=2)
    assert {k for k, r in found.items() if r.status == "ok"} == set(range(16))
    assert {(r.status, r.reason, r.attempts) for k, r in found.items() if k >= 16} == {("skipped", "run stopped: usage above its reservation", 0)}


def test_caps_hold_whatever_is_reported(spark):
    for caps, reason, sent in (
        (scoring.Caps(3, 10**9, 10**9), "max_requests", 12),
        (scoring.Caps(1000, 6000, 10**9), "max_output", None),
        (scoring.Caps(1000, 10**9, 11000), "max_input", None),
        (scoring.Caps(1000, 10**9, 10**9, time_limit_s=0), "time limit", 0),
    ):
        found = waves(spark, 20, answer, caps, wave=2)  # no usage reported: all reservations stay used
        skipped = [r for r in found.values() if r.status == "skipped"]
        assert skipped and {r.reason for r in skipped} == {f"run stopped: {reason}"}
        assert sent is None or len(found) - len(skipped) == sent


def test_reported_usage_makes_room(spark):
    """Each call reserves far more than it uses; settled, one batch's room serves them all."""
    caps = scoring.Caps(1000, 9000, 10**9)
    found = waves(spark, 20, lambda items: answer(items, usage={"input_tokens": 1, "output_tokens": 1}), caps, wave=2)
    assert {r.status for r in found.values()} == {"ok"}
    assert {r.status for r in waves(spark, 20, answer, caps, wave=2).values()} == {"ok", "skipped"}


def test_a_batch_short_of_calls_goes_again(spark):
    """Nine calls for four batches: two each. One batch needs three and gets them in the next wave."""

    def scorer(items):
        return {"stop_reason": "max_tokens"} if len(items) == 4 and items[0]["text"] == "text 0" else answer(items)

    found = waves(spark, 16, scorer, scoring.Caps(9, 10**9, 10**9), wave=4)
    assert {r.status for r in found.values()} == {"ok"} and found[0].attempts == 3
    # too few calls for it: the others are kept, it is not sent by halves
    found = waves(spark, 8, scorer, scoring.Caps(2, 10**9, 10**9), wave=2)
    assert {k for k, r in found.items() if r.status == "ok"} == set(range(4, 8))
    assert {(found[k].status, found[k].reason) for k in range(4)} == {("skipped", "run stopped: max_requests")}


def test_a_failure_can_stop_the_run(spark):
    def scorer(items):
        return {"stop_reason": "refusal"} if items[0]["text"] == "text 4" else answer(items)

    found = waves(spark, 20, scorer, ENOUGH, wave=2, stop_on_failure=True)
    assert [found[k].status for k in (0, 4, 8, 16)] == ["ok", "failed", "skipped", "skipped"]
    assert {found[k].status for k in (8, 16)} == {waves(spark, 20, scorer, ENOUGH, wave=2)[4].status.replace("failed", "skipped")}
    assert waves(spark, 0, answer, ENOUGH) == {}
