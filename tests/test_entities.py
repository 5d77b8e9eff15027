"""Search keys, edit distance, and the cascade of lookups."""

import random

import pytest

from tarnspark.functions.text import normalize, osa
from tarnspark.operators.entities import EntityError, EntityIndex
from tests.catalogue import Rows, base


@pytest.mark.parametrize("text,key", [("Ação!", "acao"), ("  The   MATRIX ", "the matrix"), ("Café", "cafe"), ("Søren Ærø", "soren aero"), ("ﬁlm", "film"), ("Straße", "strasse"), ("★", "★"), ("a​b", "ab"), ("Spider-Man: 2", "spider man 2"), ("ガ", "ガ"), ("", ""), ("WALL·E", "wall e")])
def test_keys(text, key):
    assert normalize(text) == key and normalize(key) == key


def test_osa_against_full_table():
    def full(a, b):
        d = {(i, j): i + j if not i or not j else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in "ab")
        k, want = rng.randint(0, 3), full(a, b)
        assert osa(a, b, k) == (want if want <= k else None), (a, b, k)


@pytest.fixture(scope="module")
def index(spark):
    r = base()
    r["dim_people"] += [{"sk_person_id": "d1", "nome_pessoa": "Christopher Nolan", "tipo_pessoa": "Diretor"}, {"sk_person_id": "w1", "nome_pessoa": "Christopher Nolan", "tipo_pessoa": "Roteirista"}, {"sk_person_id": "x1", "nome_pessoa": None, "tipo_pessoa": "Ator"}]
    for i, (t, y) in enumerate([("The Matrix", 1999), ("The Matrix Reloaded", 2003), ("Silence", 2016), ("Silence", None), ("Amélie", 2001), ("千と千尋", 2001)], 1):
        r.film(i, t, year=y)
    return EntityIndex(r.star(spark))


def test_exact(index):
    m = index.find("filme", "the MATRIX")
    assert m.state == "exact_unique" and m.resolved.key == "m1" and m.resolved.year == 1999
    m = index.find("filme", "Silence")
    assert m.state == "exact_multiple" and [c.key for c in m.candidates] == ["m3", "m4"] and m.resolved is None
    assert index.find("pessoa", "christopher nolan", role="director").resolved.key == "d1"
    m = index.find("pessoa", "Christopher Nolan", role="Ator")
    assert (m.state, m.reason, m.detail) == ("none", "exists_in_other_role", "Diretor, Roteirista")
    m = index.find("genero", "Ficção científica")
    assert m.resolved.label == "Science Fiction" and m.resolved.matched_via == "alias"


def test_partial_and_fuzzy(index):
    m = index.find("filme", "matrix")
    assert m.state == "partial_candidates" and [c.key for c in m.candidates] == ["m1", "m2"] and m.candidates[0].matched_via == "tokens"
    assert index.find("filme", "The Mat").candidates[0].matched_via == "prefix"
    assert index.find("filme", "千と").candidates[0].key == "m6"
    m = index.find("filme", "The Matrxi")
    assert m.state == "fuzzy_suggestions" and m.candidates[0].key == "m1" and m.candidates[0].edits == 1
    assert index.find("filme", "Ameile").candidates[0].key == "m5"


def test_none(index):
    for text, reason in (("", "empty"), ("x" * 201, "too_long"), ("a\0", "invalid_text"), ("zq", "too_short_for_partial"), ("zzzzzzzz", "no_match")):
        m = index.find("filme", text)
        assert (m.state, m.reason) == ("none", reason)
    for bad in (("x", "y", None, 10), ("filme", "y", "Ator", 10), ("pessoa", "y", "z", 10), ("filme", "y", None, 26), ("filme", "y", None, True)):
        with pytest.raises(ValueError):
            index.find(bad[0], bad[1], bad[2], bad[3])


def test_empty_kind_is_an_error(spark):
    r = Rows()
    with pytest.raises(EntityError):
        EntityIndex(r.star(spark)).find("produtora", "x")
