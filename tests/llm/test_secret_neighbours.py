"""Secrets that stand next to allowed strings."""
import hashlib

import pytest

from obsloom.llm import secrets

KEY = "Zk3vQ9xL2mRt7YpB4nWc8HsDf6JgKa1e"
UUID = "550e8400-e29b-41d4-a716-446655440000"


def hot(text):
    return [(a, b) for k, a, b in secrets.scan(text) if k == "entropy"]


@pytest.mark.parametrize("before", [UUID + "/", "EXAMPLE_KEY=", "0123456789", "sha256-" + hashlib.sha256(b"a").hexdigest() + "-", "md5-"])
def test_an_allowed_string_hides_no_neighbour(before):
    for text in (before + KEY, KEY + "/" + before + KEY):
        assert any(a <= len(text) - 32 + 8 and b == len(text) for a, b in hot(text))


def test_a_path_hides_no_hot_segment():
    assert hot("hooks/a1/b2/" + KEY.lower()) == [(12, 44)]


@pytest.mark.parametrize("text", [UUID + "/" + UUID, "usr/share/lib/python/site/packages/core", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
                                  "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
def test_allowed_strings_alone_stay_out(text):
    assert hot(text) == []
