import hashlib
import hmac
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearken.functions import text
from hearken.functions.expr import replace_matches


def apply(spark, f, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.select("k", f(F.col("v")).alias("o")).orderBy("k").select("o").collect()]


GOLDEN = [
    ("피해자: 검찰 + 사칭 (잡음) 생략 쏐-", "검찰 사칭 생략"),
    ("주민번호 1 2 3 4 5", "주민번호 12345"),
    ("계좌 1/일 2/이", "계좌 12"),
    ("아/ 저는 음/요", "저는 요"),
    ("검찰을 사칭하여 송금을 요구합니다.", "검찰을 사칭하여 송금을 요구합니다."),
    ("1 2 3 4", "1 2 3 4"),
    ("일반1가/나", "일반1가"),
    ("　 안녕 \xa0 하세요 ", "안녕 하세요"),
    ("", ""),
    (None, None),
]


def test_goldens(spark):
    assert apply(spark, text.normalize, [a for a, _ in GOLDEN]) == [b for _, b in GOLDEN]


def test_dual_runs_swallow_the_space_that_follows(spark):
    assert apply(spark, text.merge_dual_runs, ["계좌 1/일 2/이 입니다 2024/01/02"]) == ["계좌 12입니다 2024"]


#: An independent statement of each step over the alphabet that makes it act.
PLAIN = {
    "dual_runs": lambda s: re.sub(r"(?:\d[\w-]*/[^()\s]+\s*){2,}", lambda m: "".join(re.findall(r"(\d[\w-]*)/[^()\s]+", m[0])), s),
    "digits": lambda s: re.sub(r"(?:\d\s){4,}\d", lambda m: m[0].replace(" ", ""), s),
    "fillers": lambda s: re.sub(r"(?<!\S)(?:[a-z]|아|어|음|그|뭐|저|막|좀)/", " ", s),
    "spaces": lambda s: " ".join(s.split()),
}


@pytest.mark.parametrize("step", sorted(PLAIN))
def test_steps_match_plain_python(spark, step):
    found = []

    @settings(max_examples=300, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.text(alphabet="12 3/-가a아음(x)\t　é_", max_size=40))
    def gather(s):
        found.append(s)

    gather()
    assert apply(spark, text.STEPS[step], found) == [PLAIN[step](s) for s in found]


def test_replace_matches_at_the_ends(spark):
    assert apply(spark, lambda c: replace_matches(c, "x+", lambda m: F.concat(F.lit("<"), m, F.lit(">"))), ["xax", "xx", "", "a"]) == ["<x>a<x>", "<xx>", "", "a"]


def test_source_groups(spark):
    stems = ["D03_J13_S000001_merged__chunk_0001", "PHISH_001_0002", "phish_7_0001", "S000001__0196", "plain", "S1__12"]
    assert apply(spark, text.source_group, stems) == ["D03_J13_S000001_merged", "PHISH_001", "phish_7", "S000001", "plain", "S1__12"]


def test_hmac_and_redaction(spark):
    for secret in ("k", "s" * 100):
        assert apply(spark, lambda c: text.hmac_sha256(secret, c), ["10.0.0.1", "é"]) == [hmac.new(secret.encode(), x.encode(), hashlib.sha256).hexdigest() for x in ("10.0.0.1", "é")]
    assert apply(spark, lambda c: text.redact(c, ("pw",)), ["a hf_X-1 pw", "ahf_X"]) == ["a [REDACTED] [REDACTED]", "ahf_X"]


def test_new_ids(spark):
    ids = [r[0] for r in spark.range(50).select(text.new_id("job", 32)).collect()]
    assert len(set(ids)) == 50 and all(re.fullmatch(r"job_[0-9a-f]{32}", x) for x in ids)
