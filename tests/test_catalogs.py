"""Every catalog entry has a sample that matches and a look-alike that does not."""

import re

import pytest

from crawlaudit.catalog import patterns as P, tech, trackers

# (tracker, part, sample, identifier, look-alike)
TRACKER_SAMPLES = [
    ("gtm", "src", "https://www.googletagmanager.com/gtm.js?id=GTM-AB12CD", "GTM-AB12CD", "https://x.com/gtmx.js?id=GTM-AB12CD"),
    ("ga4", "hits", "https://www.google-analytics.com/g/collect?v=2&tid=G-AB12CD34", "G-AB12CD34", "https://x.com/g/collected?tid=G-1"),
    ("google-tag", "src", "https://www.googletagmanager.com/gtag/js?id=GT-AB12CD", "GT-AB12CD", "https://x.com/gtag/js?id=G-AB12CD"),
    ("ua", "code", "ga('create', 'UA-12345-6')", "UA-12345-6", "var QUA-12345-6"),
    ("google-ads", "code", "gtag('config', 'AW-987654321')", "AW-987654321", "config: AW-987654321"),
    ("clarity", "src", "https://www.clarity.ms/tag/abcd1234ef", "abcd1234ef", "https://clarity.example/tag/abcd1234ef"),
    ("hotjar", "code", "h._hjSettings={hjid:98765,hjsv:6}", "98765", "hjsid:98765x"),
    ("hubspot", "src", "https://js.hs-scripts.com/98765.js", "98765", "https://hs-scripts.example/98765.js"),
    ("matomo", "code", "_paq.push(['setSiteId', '7'])", "7", "setSiteIdentity 7"),
    ("plausible", "tag", ' data-domain="a.org" src="https://plausible.io/js/script.js"', "a.org", ' data-dom="a.org" src="https://plausible.io/x"'),
    ("fathom", "tag", ' data-site="ABCDEFG" src="https://cdn.usefathom.com/script.js"', "ABCDEFG", ' data-site="abc" src="https://cdn.usefathom.com/script.js"'),
    ("cloudflare", "tag", ' data-cf-beacon="{"token": "' + "a1" * 16 + '"}"', "a1" * 16, ' data-cf-beacon="{}"'),
    ("segment", "code", 'analytics.load("' + "Ab3" * 8 + '")', "Ab3" * 8, 'analytics.loaded("x")'),
    ("meta", "code", "fbq('init', '987654321098765')", "987654321098765", "fbq('track', 'PageView')"),
    ("tiktok", "code", "ttq.load('ABCDEFGHIJ0123456789')", "ABCDEFGHIJ0123456789", "ttq.page()"),
    ("linkedin", "code", '_linkedin_partner_id = "54321"', "54321", "linkedin_partner = 54321"),
    ("pinterest", "code", "pintrk('load', '2612345678901')", "2612345678901", "pintrk('page')"),
    ("snap", "code", "snaptr('init', 'a1b2c3d4-aaaa-bbbb-cccc-0123456789ab')", "a1b2c3d4-aaaa-bbbb-cccc-0123456789ab", "snaptr('track')"),
    ("x", "code", "twq('config','o1abc')", "o1abc", "twq('event','tw-x')"),
    ("uet", "code", "(w[u]=w[u]||[]).push({ti:'187654321'}) // uetq", "187654321", "multi: '187654321' uetq"),
    ("reddit", "code", "rdt('init','t2_abc123')", "t2_abc123", "rdt('track','PageVisit')"),
]
CONSENT_SAMPLES = {
    "cookiebot": "https://consent.cookiebot.com/uc.js", "onetrust": "https://cdn.cookielaw.org/x.js", "axeptio": "https://static.axept.io/sdk.js",
    "didomi": "https://sdk.privacy-center.org/loader.js", "cookieyes": "https://cdn-cookieyes.com/client.js", "termly": "https://app.termly.io/embed.js",
    "iubenda": "https://cdn.iubenda.com/cs.js", "osano": "https://cmp.osano.com/a/osano.js", "complianz": "https://x.org/wp-content/plugins/complianz-gdpr/a.js",
    "usercentrics": "https://app.usercentrics.eu/latest.js",
}
JAVA_END = lambda regex: regex.replace(r"\z", r"\Z")


def found(tracker, part, text):
    rows = [r for r in trackers.pattern_rows() if r["tracker"] == tracker and r["part"] == part and r["use"] != "container"]
    hits = [(m[1] if r["groups"] else None) for r in rows if r["token"] in text.lower() for m in re.finditer(JAVA_END(r["regex"]), text)]
    return hits


@pytest.mark.parametrize("tracker,part,sample,ident,alike", TRACKER_SAMPLES, ids=[t[0] for t in TRACKER_SAMPLES])
def test_tracker_samples(tracker, part, sample, ident, alike):
    assert ident in found(tracker, part, sample)
    assert not found(tracker, part, alike)


def test_consent_samples():
    for name, url in CONSENT_SAMPLES.items():
        assert found(name, "src", url), name
        assert not found(name, "src", url.replace(".", "-").replace("gdpr/", "gdprs/")), name


def test_every_tracker_is_sampled():
    assert {t["id"] for t in trackers.TRACKERS} == {t[0] for t in TRACKER_SAMPLES} | set(CONSENT_SAMPLES)
    assert len(trackers.TRACKERS) == 31 and len(tech.TECH) == 73


def test_catalogs_are_valid():
    trackers.validate(trackers.TRACKERS)
    tech.validate(tech.TECH)
    with pytest.raises(ValueError):
        trackers.validate([dict(id="a", name="A", group="nope")])
    with pytest.raises(ValueError):
        P.token_regex(["ab", "abc"])


def test_tokens_find_overlaps():
    regex = re.compile(P.token_regex(["abc", "bcd", "x"]))
    assert regex.findall("abcd x") == ["abc", "bcd", "x"]


def test_tokens_occur_in_what_patterns_match():
    """A pattern's own token must appear in any text it matches: spot-checked on literal patterns."""
    for r in tech.pattern_rows():
        assert r["token"] == r["token"].lower()
