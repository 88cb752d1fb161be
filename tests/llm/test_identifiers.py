"""The secret models on names and on random strings that they were not trained on."""

import email.message
import http.client
import logging
import random
import socket
import ssl
import string
import tarfile

import pytest

from packetloom.llm import secrets
from packetloom.llm.common import read

LETTERS = string.ascii_letters + string.digits
ALPHABETS = {
    "letters and digits": LETTERS,
    "base64": LETTERS + "+/",
    "base32": string.ascii_uppercase + "234567",
    "lower case": string.ascii_lowercase + string.digits,
    "hex": "0123456789abcdef",
}


@pytest.fixture(scope="module")
def models(spark):
    return secrets.train(read(spark, "/root/testdata/sf0.01", "documents"))


def found(models, text):
    return bool(secrets.all_spans(f"see {text} there", models)[1])


def names():
    out = set()
    for module in (socket, ssl, http.client, logging, email.message, tarfile):
        for name, value in vars(module).items():
            out |= {name, *(vars(value) if isinstance(value, type) else ())}
    return sorted(n for n in out if len(n) >= secrets.LEAST_TOKEN)


def test_precision_and_recall_on_held_out_samples(models):
    rng = random.Random(3)
    ordinary = names()
    strings = [
        "".join(rng.choice(letters) for _ in range(rng.randint(20, 31)))
        for letters in ALPHABETS.values()
        for _ in range(100)
    ]
    false = sum(found(models, n) for n in ordinary) / len(ordinary)
    true = sum(found(models, s) for s in strings) / len(strings)
    assert len(ordinary) > 300
    assert true >= 0.9, true
    assert true / (true + false) >= 0.9, false


@pytest.mark.parametrize(
    "text",
    [
        "FLAG_ACTIVITY_NEW_TASK_CLEAR",
        "getElementsByClassName",
        "application/x-www-form-urlencoded",
        "com-example-project-v2-build-1234",
        "/usr/local/lib/python3/site-packages",
        "3f2504e0-4f89-41d3-9a0c-0305e82c3301",
        "550E8400-E29B-41D4-A716-446655440000",
    ],
)
def test_ordinary_names_stay(models, text):
    assert not found(models, text)


def test_no_words_at_all(spark):
    models = secrets.train(spark.createDataFrame([], "doc_id long, text string"))
    assert models.score("") == 0.0 and models.score("ab") == pytest.approx(0.0)
