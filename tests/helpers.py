"""Small in-memory answers to compare the Spark jobs with."""

from twinsift.functions.bits import signed64
from twinsift.schemas import RECORD_SCHEMA


def rec(path, nbytes=10, w=10, h=10, sha="S", pixel=None, phash=None):
    value = None if phash is None else signed64(phash)
    return (path, nbytes, w, h, "png", sha, pixel, value)


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def distance(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


def brute_pairs(values, threshold):
    values = sorted(set(values))
    return {
        (a, b, distance(a, b))
        for i, a in enumerate(values)
        for b in values[i + 1 :]
        if distance(a, b) <= threshold
    }


def brute_components(nodes, pairs):
    label = {n: n for n in nodes}

    def find(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            label[max(ra, rb)] = min(ra, rb)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return {frozenset(g) for g in groups.values()}
