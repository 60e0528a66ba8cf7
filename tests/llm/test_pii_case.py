"""Spelled-out addresses are found in any case, and whether or not the text has a digit elsewhere."""

import pytest

from quillon.llm import pii


@pytest.mark.parametrize("address", ["JOHN (AT) SITE (DOT) COM", "John (At) Site (Dot) Com", "john [aT] site (dot) com"])
def test_spelled_in_any_case(address):
    weights = dict(pii.trained())
    text = f"please write to {address} for more"
    plain = pii.find(text, weights)[1]
    assert ("email", 16, 16 + len(address)) in plain
    assert plain == pii.find(text + " word" * 40 + " 7", weights)[1]
