"""Tracker catalog: identifiers, public snippet formats and collection endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .patterns import group_count

GROUPS = ["analytics", "ads", "consent"]

# Shared pieces of snippet formats.
_Q = r"""\\?["']"""          # a quote, escaped inside container JSON
_S = r"\\?/"                 # a slash, escaped inside container JSON
_UUID = "[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
_END = "(?![a-z0-9])"
_TAG_SPAN = r"[\s\S]{0,4000}?"


def _query(name: str, value: str) -> str:
    """A query string up to and including one captured parameter."""
    return rf"""\?(?:[^#\s"'<>]*?&(?:amp;)?)?{name}=({value})"""


def _call(fn: str, first: str, value: str) -> str:
    """fn('first', 'value') with the value captured."""
    return rf"{fn}\(\s*{_Q}{first}{_Q}\s*,\s*{_Q}({value}){_Q}"


def _quoted(value: str) -> str:
    return f'"({value})"'


def _field(name: str, value: str) -> str:
    return f'"{name}":"({value})"'


def _config(value: str) -> str:
    return rf"{_Q}config{_Q}\s*,\s*{_Q}({value}){_Q}"


# One tracker: identity, then rows (token, pattern, label[, id prefix]) by use.
#   src   its script's address          hits  its collection request
#   code  inline or noscript code       tag   attributes of a script tag
#   gtm   a container field             var   a container field set by a variable
#   live  runtime keys (key, evidence kind, label)
_GTM, _GA, _GT, _UA = "GTM-[A-Z0-9]{4,10}", "G-[A-Z0-9]{6,12}", "GT-[A-Z0-9]{6,12}", r"UA-\d{4,10}-\d{1,4}"
_AW, _CLARITY, _HOTJAR, _HUBSPOT = r"AW-\d{8,12}", "[a-z0-9]{8,12}", r"\d{5,9}", r"\d{5,10}"
_SEGMENT, _META, _TIKTOK, _REDDIT = "[A-Za-z0-9]{20,40}", r"\d{15,17}", "[A-Z0-9]{20}", "(?:t2|a2)_[a-z0-9]{4,14}"
_GOOGLE_LIVE = [("gtm", "loaded", "live google_tag_manager")]
_GTAG_LIVE = [*_GOOGLE_LIVE, ("dataLayer.config", "code", "dataLayer config")]

# The whole table. Addresses, snippet names and identifier formats are those of the vendors' own snippets.
TRACKERS = [
    dict(id="gtm", name="Google Tag Manager", short="GTM", group="analytics", sends=False, ran="google", format=_GTM,
         src=[("/gtm.js", r"/gtm\.js" + _query("id", _GTM), "gtm.js")],
         code=[("gtm-", f"{_Q}({_GTM}){_Q}", "GTM snippet"), ("ns.html", r"ns\.html" + _query("id", _GTM), "GTM iframe")],
         live=_GOOGLE_LIVE),
    dict(id="ga4", name="Google Analytics 4", short="GA4", group="analytics", ran="google", format=_GA,
         src=[("/gtag/js", "/gtag/js" + _query("id", _GA), "gtag.js")],
         hits=[("/g/collect", "/g/collect" + _query("tid", _GA), "/g/collect")],
         code=[("config", _config(_GA), "gtag config"), ("gtag", f"gtag{_S}js" + _query("id", _GA), "gtag.js")],
         gtm=[('"g-', _quoted(_GA), "GA4 ID")], live=_GTAG_LIVE),
    dict(id="google-tag", name="Google tag", short="Google tag", group="analytics", sends=False, ran="google", format=_GT,
         src=[("/gtag/js", "/gtag/js" + _query("id", _GT), "gtag.js")],
         code=[("config", _config(_GT), "gtag config"), ("gtag", f"gtag{_S}js" + _query("id", _GT), "gtag.js")],
         gtm=[('"gt-', _quoted(_GT), "Google tag ID")], live=_GTAG_LIVE),
    dict(id="ua", name="Universal Analytics", short="UA", group="analytics", retired=True, format=_UA,
         src=[("/gtag/js", "/gtag/js" + _query("id", _UA), "gtag.js"),
              ("google-analytics.com", r"google-analytics\.com/(?:analytics|ga)\.js", "analytics.js")],
         hits=[("google-analytics.com", r"google-analytics\.com/(?:[rj]/)?collect" + _query("tid", _UA), "google-analytics.com/collect")],
         code=[("ua-", f"{_Q}({_UA}){_Q}", "UA ID")], live=_GTAG_LIVE),
    dict(id="google-ads", name="Google Ads", short="Google Ads", group="ads", format=_AW,
         src=[("/gtag/js", "/gtag/js" + _query("id", _AW), "gtag.js"),
              ("googleadservices.com", r"googleadservices\.com/pagead/conversion(?:_async)?\.js", "conversion.js")],
         hits=[("googleadservices.com", r"googleadservices\.com/pagead/conversion/(\d{8,12})/", "googleadservices.com conversion", "AW-"),
               ("doubleclick.net", r"googleads\.g\.doubleclick\.net/pagead/viewthroughconversion/(\d{8,12})/", "doubleclick.net viewthroughconversion", "AW-"),
               ("/pagead/1p-", r"google\.[a-z.]+/pagead/1p-(?:user-list|conversion)/(\d{8,12})/", "google.com pagead", "AW-")],
         code=[("config", _config(_AW), "gtag config"),
               ("google_conversion_id", rf"google_conversion_id\s*=\s*(?:{_Q})?(\d{{8,12}})", "google_conversion_id", "AW-")],
         gtm=[('"aw-', _quoted(_AW), "Google Ads ID"), ("vtp_conversionid", _field("vtp_conversionId", r"\d{8,12}"), "Google Ads tag", "AW-")],
         live=_GTAG_LIVE),
    dict(id="clarity", name="Microsoft Clarity", short="Clarity", group="analytics", format=_CLARITY,
         src=[("clarity.ms", rf"clarity\.ms/tag/({_CLARITY}){_END}", "clarity.ms/tag"),
              ("clarity.ms", r"""clarity\.ms/[^\s"'?#]*clarity\.js""", "clarity.js")],
         hits=[("clarity.ms", r"[a-z]\.clarity\.ms/collect", "clarity.ms/collect")],
         code=[("clarity", rf"{_Q}clarity{_Q}\s*,\s*{_Q}script{_Q}\s*,\s*{_Q}({_CLARITY}){_Q}", "Clarity snippet"),
               ("clarity", rf"clarity\.ms{_S}tag{_S}({_CLARITY}){_END}", "clarity.ms/tag")],
         live=[("global:clarity", "code", "clarity function")]),
    dict(id="hotjar", name="Hotjar", short="Hotjar", group="analytics", format=_HOTJAR,
         src=[("hotjar.", rf"static\.hotjar\.com/c/hotjar-({_HOTJAR})\.js", "hotjar.js"),
              ("hotjar.", r"script\.hotjar\.com/modules", "Hotjar modules")],
         hits=[("hotjar.", rf"in\.hotjar\.com/api/v\d+/client/sites/({_HOTJAR})/", "in.hotjar.com"),
               ("hotjar.", r"(?:in|vc)\.hotjar\.(?:com|io)/", "hotjar.com")],
         code=[("hjid", rf"hjid\s*:\s*({_HOTJAR})", "Hotjar snippet"), ("hotjar-", rf"hotjar-({_HOTJAR})\.js", "hotjar.js")],
         gtm=[("__hjtc", rf'"function":"__hjtc"{_TAG_SPAN}"vtp_hotjar_site_id":"({_HOTJAR})"', "Hotjar tag")],
         var=[("__hjtc", rf'"function":"__hjtc"{_TAG_SPAN}"vtp_hotjar_site_id":\["macro"', "Hotjar tag")],
         live=[("hotjar.site", "loaded", "live hjSiteSettings"), ("hotjar.settings", "code", "_hjSettings")]),
    dict(id="hubspot", name="HubSpot", short="HubSpot", group="analytics", format=_HUBSPOT,
         src=[("hs-scripts.com", rf"js(?:-[a-z0-9]+)?\.hs-scripts\.com/({_HUBSPOT})\.js", "hs-scripts.com loader"),
              ("hs-analytics.net", rf"js(?:-[a-z0-9]+)?\.hs-analytics\.net/analytics/\d+/({_HUBSPOT})\.js", "hs-analytics.net")],
         hits=[("hubspot.com", r"track(?:-[a-z0-9]+)?\.hubspot\.com/__pt[a-z]\.gif" + _query("a", _HUBSPOT), "track.hubspot.com")],
         code=[("hs-scripts.com", rf"hs-scripts\.com{_S}({_HUBSPOT})\.js", "HubSpot loader")],
         live=[("global:_hsq", "code", "_hsq queue")]),
    dict(id="matomo", name="Matomo", short="Matomo", group="analytics", format=r"\d{1,6}",
         src=[(t, rf"/{t}\.js(?:[?#]|\z)", "matomo.js") for t in ("matomo", "piwik")],
         hits=[(t, rf"/{t}\.php" + _query("idsite", r"\d{1,6}"), "matomo.php") for t in ("matomo", "piwik")],
         code=[("setsiteid", rf"{_Q}setSiteId{_Q}\s*,\s*(?:{_Q})?(\d{{1,6}})", "_paq setSiteId")],
         live=[("matomo.site", "code", "_paq setSiteId")]),
    dict(id="plausible", name="Plausible", short="Plausible", group="analytics", format=r"(?i)[a-z0-9.-]+\.[a-z]{2,}",
         src=[("plausible.io", r"plausible\.io/js/[A-Za-z0-9_.-]+\.js", "plausible.io script")],
         hits=[("plausible.io", r"plausible\.io/api/event", "plausible.io/api/event")],
         tag=[("plausible", r'data-domain="([^"\s,]+)"', "data-domain")],
         live=[("global:plausible", "code", "plausible function")]),
    dict(id="fathom", name="Fathom", short="Fathom", group="analytics", format="[A-Z]{4,10}",
         src=[("usefathom.com", r"cdn\.usefathom\.com/script\.js", "usefathom.com script")],
         hits=[("usefathom.com", r"usefathom\.com/" + _query("sid", "[A-Z]{4,10}"), "usefathom.com")],
         tag=[("usefathom", r'data-site="([A-Z]{4,10})"', "data-site")],
         live=[("global:fathom", "loaded", "fathom object")]),
    dict(id="cloudflare", name="Cloudflare Web Analytics", short="Cloudflare", group="analytics", format="[a-f0-9]{32}",
         src=[("cloudflareinsights.com", r"static\.cloudflareinsights\.com/beacon\.min\.js", "beacon.min.js")],
         hits=[("/cdn-cgi/rum", r"/cdn-cgi/rum(?:[?#]|\z)", "/cdn-cgi/rum")],
         tag=[("data-cf-beacon", r'data-cf-beacon="\{[^}]*?"token"\s*:\s*"([a-f0-9]{32})"', "data-cf-beacon")],
         live=[("global:__cfBeacon", "loaded", "__cfBeacon")]),
    dict(id="segment", name="Segment", short="Segment", group="analytics", format=_SEGMENT,
         src=[("cdn.segment.", rf"cdn\.segment\.(?:com|io)/analytics\.js/v1/({_SEGMENT})/analytics(?:\.min)?\.js", "analytics.js")],
         hits=[("api.segment.io", r"api\.segment\.io/v1/[a-z]+", "api.segment.io")],
         code=[("analytics.load", rf"analytics\.load\(\s*{_Q}({_SEGMENT}){_Q}", "analytics.load")]),
    dict(id="meta", name="Meta Pixel", short="Meta Pixel", group="ads", ran="fbq", format=_META, template=r"connect\.facebook\.net",
         src=[("connect.facebook.net", rf"connect\.facebook\.net/signals/config/({_META})", "signals/config"),
              ("connect.facebook.net", r"connect\.facebook\.net/[A-Za-z_]+/fbevents\.js", "fbevents.js")],
         hits=[("facebook.com/", r"facebook\.com/tr/?" + _query("id", _META), "facebook.com/tr"),
               ("facebook.com/", r"facebook\.com/privacy_sandbox/pixel/register/trigger/?" + _query("id", _META), "facebook.com/privacy_sandbox"),
               ("facebook.com/", r"facebook\.com/tr/?(?:[?#]|\z)", "facebook.com/tr")],
         code=[("fbq(", _call("fbq", "init", _META), "fbq init"),
               ("facebook.com", rf"facebook\.com{_S}tr(?:{_S})?" + _query("id", _META), "facebook.com/tr"),
               ("connect.facebook.net", rf"connect\.facebook\.net{_S}[A-Za-z_]+{_S}fbevents\.js", "fbevents.js loader")],
         gtm=[("vtp_pixelid", _field("vtp_pixelId", _META), "Meta Pixel template")],
         var=[("vtp_pixelid", rf'"function":"(__cvt_[A-Za-z0-9_]+)"{_TAG_SPAN}"vtp_pixelId":\["macro"', "Meta Pixel template")],
         live=[("fbq.pixels", "loaded", "live fbq state"), ("fbq.queue", "code", "queued fbq init"), ("global:fbq", "code", "fbq function")]),
    dict(id="tiktok", name="TikTok Pixel", short="TikTok", group="ads", format=_TIKTOK,
         src=[("analytics.tiktok.com", r"analytics\.tiktok\.com/i18n/pixel/events\.js" + _query("sdkid", _TIKTOK), "events.js"),
              ("analytics.tiktok.com", r"analytics\.tiktok\.com/i18n/pixel/(?:events|sdk|static/[A-Za-z0-9_.-]+)\.js", "TikTok pixel script")],
         hits=[("analytics.tiktok.com", r"analytics\.tiktok\.com/api/v\d/pixel", "analytics.tiktok.com/api")],
         code=[("ttq.load", rf"ttq\.load\(\s*{_Q}({_TIKTOK}){_Q}", "ttq.load")],
         gtm=[(t, rf'"vtp_pixel_?[cC]ode":"({_TIKTOK})"', "TikTok template") for t in ("vtp_pixelcode", "vtp_pixel_code")],
         live=[("ttq.pixels", "code", "ttq pixels"), ("global:ttq", "code", "ttq object")]),
    dict(id="linkedin", name="LinkedIn Insight Tag", short="LinkedIn", group="ads", format=r"\d{3,10}",
         src=[("snap.licdn.com", r"snap\.licdn\.com/li\.lms-analytics/insight(?:\.min)?\.js", "insight.min.js")],
         hits=[("px.ads.linkedin.com", r"px\.ads\.linkedin\.com/(?:collect|attribution_trigger)/?" + _query("pid", r"\d{3,10}"), "px.ads.linkedin.com"),
               ("px.ads.linkedin.com", r"px\.ads\.linkedin\.com/", "px.ads.linkedin.com")],
         code=[("_linkedin_partner_id", rf"_linkedin_partner_id\s*=\s*(?:{_Q})?(\d{{3,10}})", "_linkedin_partner_id"),
               ("px.ads.linkedin.com", rf"px\.ads\.linkedin\.com{_S}collect(?:{_S})?" + _query("pid", r"\d{3,10}"), "px.ads.linkedin.com")],
         gtm=[("__bzi", rf'"function":"__bzi"{_TAG_SPAN}"vtp_id":"(\d{{3,10}})"', "LinkedIn Insight tag")],
         live=[("linkedin.partner", "code", "_linkedin_partner_id")]),
    dict(id="pinterest", name="Pinterest Tag", short="Pinterest", group="ads", format=r"\d{13}",
         src=[("s.pinimg.com", r"s\.pinimg\.com/ct/(?:core|lib/main\.[a-z0-9]+)\.js", "pinimg.com core.js")],
         hits=[("ct.pinterest.com", r"ct\.pinterest\.com/(?:v3|user)/?" + _query("tid", r"\d{13}"), "ct.pinterest.com")],
         code=[("pintrk(", _call("pintrk", "load", r"\d{13}"), "pintrk load"),
               ("ct.pinterest.com", rf"ct\.pinterest\.com{_S}v3(?:{_S})?" + _query("tid", r"\d{13}"), "ct.pinterest.com")],
         gtm=[("__pntr", rf'"function":"__pntr"{_TAG_SPAN}"vtp_tagId":"(\d{{13}})"', "Pinterest tag")],
         live=[("global:pintrk", "code", "pintrk function")]),
    dict(id="snap", name="Snap Pixel", short="Snap", group="ads", format=_UUID,
         src=[("sc-static.net", r"sc-static\.net/scevent\.min\.js", "scevent.min.js")],
         hits=[("snapchat.com", r"tr(?:-shadow)?\.snapchat\.com/[^\s?#]*" + _query("pid", _UUID), "tr.snapchat.com"),
               ("snapchat.com", r"tr(?:-shadow)?\.snapchat\.com/", "tr.snapchat.com")],
         code=[("snaptr(", _call("snaptr", "init", _UUID), "snaptr init")],
         live=[("global:snaptr", "code", "snaptr function")]),
    dict(id="x", name="X (Twitter) pixel", short="X pixel", group="ads", format="[a-z0-9]{4,8}",
         src=[("ads-twitter.com", r"static\.ads-twitter\.com/(?:uwt|oct)\.js", "uwt.js")],
         hits=[("/i/adsct", r"(?:analytics\.twitter\.com|t\.co)/i/adsct" + _query("txn_id", "[a-z0-9]{4,8}") + _END, "i/adsct"),
               ("/i/adsct", r"(?:analytics\.twitter\.com|t\.co)/i/adsct", "i/adsct")],
         code=[("twq(", _call("twq", "(?:config|init)", "[a-z0-9]{4,8}"), "twq config")],
         live=[("global:twq", "code", "twq function")]),
    dict(id="uet", name="Microsoft Advertising UET", short="UET", group="ads", format=r"\d{6,10}",
         src=[("bat.bing.", r"bat\.bing\.com/bat\.js", "bat.js")],
         hits=[("bat.bing.", r"bat\.bing\.(?:com|net)/action/0" + _query("ti", r"\d{6,10}"), "bat.bing.com/action"),
               ("bat.bing.", r"bat\.bing\.(?:com|net)/action/", "bat.bing.com/action")],
         code=[(t, rf"(?<![A-Za-z0-9_])ti\s*:\s*{_Q}(\d{{6,10}}){_Q}", "UET tag") for t in ("uetq", "bat.bing")],
         live=[("global:uetq", "code", "uetq queue")]),
    dict(id="reddit", name="Reddit Pixel", short="Reddit", group="ads", format=_REDDIT,
         src=[("redditstatic.com", r"redditstatic\.com/ads/(?:v2/)?pixel\.js", "pixel.js"),
              ("pixel-config.reddit.com", rf"pixel-config\.reddit\.com/pixels/({_REDDIT})/", "pixel config")],
         hits=[("alb.reddit.com", r"alb\.reddit\.com/rp\.gif" + _query("id", _REDDIT), "alb.reddit.com"),
               ("alb.reddit.com", r"alb\.reddit\.com/rp\.gif", "alb.reddit.com")],
         code=[("rdt(", _call("rdt", "init", _REDDIT), "rdt init")],
         live=[("global:rdt", "code", "rdt function")]),
]

# Consent banners: id, name, (token, host pattern) per script, (global, evidence kind) per runtime object.
_CONSENT = [
    ("cookiebot", "Cookiebot", [("cookiebot.", r"consent(?:cdn)?\.cookiebot\.(?:com|eu)/")], [("Cookiebot", "loaded")]),
    ("onetrust", "OneTrust",
     [("cdn.cookielaw.org", r"cdn\.cookielaw\.org/"), ("cookie-cdn.cookiepro.com", r"cookie-cdn\.cookiepro\.com/"),
      ("optanon.blob", r"optanon\.blob\.core\.windows\.net/")], [("OneTrust", "loaded"), ("OptanonWrapper", "code")]),
    ("axeptio", "Axeptio", [("axept.io", r"(?:static|client)\.axept\.io/")], [("axeptioSettings", "code")]),
    ("didomi", "Didomi", [("sdk.privacy-center.org", r"sdk\.privacy-center\.org/")], [("Didomi", "loaded"), ("didomiConfig", "code")]),
    ("cookieyes", "CookieYes", [("cdn-cookieyes.com", r"cdn-cookieyes\.com/")], [("getCkyConsent", "loaded")]),
    ("termly", "Termly", [("app.termly.io", r"app\.termly\.io/")], [("Termly", "loaded")]),
    ("iubenda", "Iubenda", [("iubenda.com", r"(?:cdn|cs)\.iubenda\.com/")], [("_iub", "code")]),
    ("osano", "Osano", [("cmp.osano.com", r"cmp\.osano\.com/")], [("Osano", "loaded")]),
    ("complianz", "Complianz", [("complianz-gdpr", r"/wp-content/plugins/complianz-gdpr(?:-premium)?/")], [("complianz", "code")]),
    ("usercentrics", "Usercentrics", [("usercentrics.eu", r"(?:app|web\.cmp|privacy-proxy)\.usercentrics\.eu/")],
     [("UC_UI", "loaded"), ("__ucCmp", "loaded")]),
]
# Consent tools, known by the address of their script.
TRACKERS += [
    dict(id=i, name=n, short=n, group="consent", sends=False, no_id=True, src=[(t, p, f"{n} script") for t, p in scripts],
         live=[(f"global:{g}", kind, f"{g} {'object' if kind == 'loaded' else 'settings'}") for g, kind in live])
    for i, n, scripts, live in _CONSENT
]

USES = ("src", "hits", "code", "tag", "gtm", "var")


def pattern_rows(catalog: list[dict] | None = None) -> list[dict]:
    """One row per pattern. Addresses try src before hits; containers reuse code patterns that capture."""
    out = []

    def add(use, part, t, ordinal, row):
        token, regex, label, *prefix = row
        out.append(dict(
            use=use, token=token, tracker=t["id"], part=part, pat_ord=ordinal, regex=regex, groups=group_count(regex),
            label=label, prefix=prefix[0] if prefix else None,
        ))

    for t in catalog or TRACKERS:
        for part in USES:
            for i, row in enumerate(t.get(part, [])):
                add({"src": "url", "hits": "url", "gtm": "container", "var": "container"}.get(part, part), part, t, i, row)
                if part == "code" and group_count(row[1]):
                    add("container", "code", t, i, row)
    return out


PATTERN_SCHEMA = "use string, token string, tracker string, part string, pat_ord int, regex string, groups int, label string, prefix string"
TRACKER_SCHEMA = (
    "tracker string, cat_ord int, group_ord int, name string, short string, `group` string, sends boolean, retired boolean, "
    "no_id boolean, format string, ran string, template string"
)


def validate(catalog: list[dict]) -> list[dict]:
    """Unique ids, known groups, patterns with at most one group."""
    ids = [t["id"] for t in catalog]
    if len(set(ids)) != len(ids):
        raise ValueError("duplicate tracker id")
    unknown = {t["group"] for t in catalog} - set(GROUPS)
    if unknown:
        raise ValueError(f"unknown group {sorted(unknown)}")
    pattern_rows(catalog)
    return catalog


def formats(catalog: list[dict] | None = None) -> list[str]:
    return sorted({t["format"] for t in catalog or TRACKERS if t.get("format")})


def tracker_table(spark: SparkSession, catalog=None) -> DataFrame:
    rows = [
        (t["id"], i, GROUPS.index(t["group"]), t["name"], t.get("short", t["name"]), t["group"], t.get("sends", True),
         t.get("retired", False), t.get("no_id", False), t.get("format"), t.get("ran"), t.get("template"))
        for i, t in enumerate(catalog or TRACKERS)
    ]
    return spark.createDataFrame(rows, TRACKER_SCHEMA)


def live_table(spark: SparkSession, catalog=None) -> DataFrame:
    rows = [(t["id"], k, kind, label, t.get("format")) for t in catalog or TRACKERS for k, kind, label in t.get("live", [])]
    return spark.createDataFrame(rows, "tracker string, key string, kind string, label string, format string")
