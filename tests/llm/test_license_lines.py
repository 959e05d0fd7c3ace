"""Every notice is found in the middle of long lines of other words."""

import random

import pytest

from docketry.llm import op1_licenses
from docketry.llm.common import table
from docketry.llm.license_notices import NOTICES


@pytest.fixture(scope="module")
def model(spark):
    return op1_licenses.train(op1_licenses.corpus_paragraphs(table(spark, "/root/testdata/sf0.001", "documents")))


@pytest.mark.parametrize("length", [20, 100, 400])
def test_notices_inside_long_lines(model, length):
    rng = random.Random(length)
    common = "the of and to in is that for it with as was on be by this are from or at which not have".split()
    for family, notices in NOTICES.items():
        for notice in notices:
            words = [rng.choice(common) if rng.random() < 0.4 else f"word{rng.randrange(500)}" for _ in range(length)]
            line = " ".join([*words[:length // 2], notice, *words[length // 2:]])
            found = model.judge(line)
            assert (found[0], found[3]) == (family, True), (notice, found)
            assert not model.judge(" ".join(words))[3]
