import random

from hypothesis import given, settings, strategies as st

from keyfold.functions import similarity as S


def plain_lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def plain_partial(a, b):
    if not a and not b:
        return 100.0
    best = 0.0
    for needle, hay in ((a, b), (b, a)):
        if len(needle) > len(hay) or not needle:
            continue
        m, n = len(needle), len(hay)
        windows = [hay[:i] for i in range(1, m)] + [hay[i:i + m] for i in range(n)]
        best = max([best] + [200.0 * plain_lcs(needle, w) / (m + len(w)) for w in windows])
    return best


words = st.text(alphabet="abcd ", max_size=14)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_ratios_equal_their_definition(a, b):
    assert S.lcs_length(a, b) == plain_lcs(a, b)
    assert abs(S.partial_ratio(a, b) - plain_partial(a, b)) < 1e-9


def test_known_scores():
    assert S.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100.0
    assert S.partial_ratio("google cloud", "google cloud platform") == 100.0
    assert round(S.indel_ratio("this is a test", "this is a test!"), 2) == 96.55


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet="abcde ", min_size=1, max_size=16), min_size=1, max_size=25),
       st.text(alphabet="abcde ", min_size=1, max_size=16), st.sampled_from([60, 75, 85, 95, 100]))
def test_index_finds_the_first_match_of_a_full_scan(names, probe, threshold):
    index = S.NameIndex(names, threshold)
    full = next((i for i, n in enumerate(names) if S.name_score(S.expand(probe), S.expand(n)) >= threshold), None)
    assert index.first_match(probe) == full


def test_index_on_company_like_names():
    rng = random.Random(7)
    parts = ["amazon", "web", "services", "google", "cloud", "platform", "micro", "soft", "data", "systems", "inc"]
    names = [" ".join(rng.sample(parts, rng.randint(1, 3))) for _ in range(150)]
    index = S.NameIndex(names, 85)
    for probe in names[:40] + ["AWS", "gcp", "amazn web servces", "systms data"]:
        full = next((i for i, n in enumerate(names) if S.name_score(S.expand(probe), S.expand(n)) >= 85), None)
        assert index.first_match(probe) == full
