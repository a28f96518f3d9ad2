"""Secrets of any length are one span."""

import time

import pytest

from tidemark.llm import pii


@pytest.mark.parametrize("size", [12, 200, 201, 5000])
def test_secret_runs_to_its_end(size):
    text = f'token = "{"aB3." * size}"'[: 9 + size] + '" end'
    assert pii.mask(text, pii.find(text)) == 'token = "<SECRET>" end'


def test_long_runs_take_time_in_proportion():
    text = "token=" * 200_000 + " " + "password: " + "x" * 1_000_000
    start = time.process_time()
    assert [s[2] for s in pii.find(text)] == ["secret", "secret"]
    assert time.process_time() - start < 10
