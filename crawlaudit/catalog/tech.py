"""Technology catalog: public fingerprints with the rank of each source (G1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .patterns import group_count

GROUPS = ["platform", "framework", "plugin", "hosting", "server"]
# Strength of each evidence source, lower wins.
RANK = {"generator": 1, "live": 2, "dom": 2, "header": 3, "body": 4, "comment": 4, "url": 5, "inline": 6, "ns": 7, "implied": 99}

# Shared pieces of version formats.
_V2 = r"(\d+\.\d+(?:\.\d+)?)"
_VN = r"(\d+(?:\.\d+){1,3})"
_V3 = r"(\d+\.\d+\.\d+)"
_STOP = "(?![A-Za-z0-9_.])"
_WORD_END = "(?![A-Za-z0-9_])"
_VERQ = r"""\?(?:[^#\s"'<>]*?&(?:amp;)?)?ver="""
_FILE_END = r"(?:[?#]|\z)"
_CLASS = r"(?:^|\s)"
_CLASS_END = r"(?=\s|\z)"


def _tech(id, name, group, implies=(), npm=None, wp=(), wporg=None, ns=(), **sources):
    return dict(id=id, name=name, group=group, implies=implies, npm=npm, wp=wp, wporg=wporg, ns=ns, sources=sources)


def _any(*names):
    """Headers whose presence is enough."""
    return [(n, ".") for n in names]


# Rows: generator/url/inline/comment/body are (token, pattern, label[, rank]); header is (name, pattern);
# dom and live are (key, label) or (key, label, "version") when the value is the version.
# The whole table. Names, folders, addresses, markers and formats are what the vendors' own pages, headers
# and packages carry; they are written as patterns because versions stand inside them. Word characters are spelled out as
# classes and ends as look-arounds, since pages mix scripts and the engine's own shorthands are ASCII or Unicode by flag.
TECH = [
    _tech("wordpress", "WordPress", "platform",
          generator=[("wordpress", rf"^WordPress(?:\s+{_V2}{_STOP})?(?![A-Za-z0-9_-])", "generator")],
          url=[("/wp-includes/", rf"/wp-includes/(?:css|blocks)/[^?#\s]*{_VERQ}{_V2}{_STOP}", "core stylesheet", 2),
               ("/wp-includes/", rf"/wp-includes/js/wp-emoji-release\.min\.js{_VERQ}{_V2}{_STOP}", "wp-emoji-release.min.js", 2),
               ("/wp-includes/", "/wp-includes/", "wp-includes/ asset"),
               ("/wp-content/", "/wp-content/(?:themes|plugins)/", "wp-content/ asset")],
          inline=[("wp-emoji-release", rf"wp-emoji-release\.min\.js\?ver={_V2}{_STOP}", "emoji settings (wp-emoji-release.min.js)", 2)],
          header=[("link", r'rel="?https://api\.w\.org/'), ("x-pingback", r"/xmlrpc\.php")],
          dom=[("restLink", "REST API link (api.w.org)")],
          body=[("-theme-", rf"{_CLASS}wp-(?:child-)?theme-[A-Za-z0-9_-]+", "body class")]),
    _tech("woocommerce", "WooCommerce", "platform", implies=("wordpress",), wp=("woocommerce",), wporg="woocommerce", ns=("wc/", "wc-"),
          generator=[("woocommerce", rf"^WooCommerce\s+{_VN}", "generator")],
          body=[("woocommerce", rf"{_CLASS}woocommerce(?:-[A-Za-z0-9_-]+)?{_CLASS_END}", "body class")]),
    _tech("shopify", "Shopify", "platform", live=[("shopify.theme", "live Shopify.theme")],
          inline=[("shopify.theme", r"(?<![A-Za-z0-9_])Shopify\.theme\s*=\s*\{", "Shopify.theme in an inline script")],
          url=[("cdn.shopify.com", r"^https?://cdn\.shopify\.com/shopifycloud/", "cdn.shopify.com/shopifycloud/ script"),
               ("/cdn/shop/t/", r"/cdn/shop/t/\d+/assets/", "theme asset (/cdn/shop/t/)")],
          header=[("powered-by", f"^Shopify{_WORD_END}"), *_any("x-shopid", "x-shopify-stage")]),
    _tech("drupal", "Drupal", "platform", live=[("drupal", "live Drupal global")],
          generator=[("drupal", rf"^Drupal(?:\s+(\d+(?:\.\d+)*))?{_STOP}", "generator")],
          header=[("x-generator", rf"^Drupal(?:\s+(\d+(?:\.\d+)*))?{_STOP}"), *_any("x-drupal-cache", "x-drupal-dynamic-cache")],
          url=[("/core/misc/drupal", r"/core/misc/drupal(?:\.init)?\.js", "core/misc/drupal.js"),
               ("/sites/", rf"/sites/(?:default|all)/(?:files|themes|modules)/[^?#\s]+\.(?:css|js){_FILE_END}", "sites/default/ asset")]),
    _tech("joomla", "Joomla", "platform", live=[("joomla", "live Joomla global")],
          generator=[("joomla", rf"^Joomla!?(?:\s+(\d+(?:\.\d+)*))?{_STOP}", "generator")],
          url=[("/media/", "/media/(?:jui|system)/js/", "media/system/js/ script"),
               ("/media/", "/media/templates/site/", "media/templates/site/ asset")]),
    _tech("wix", "Wix", "platform",
          generator=[("wix.com", r"^Wix\.com Website Builder", "generator")],
          header=[*_any("x-wix-request-id"), ("server", f"^Pepyaka{_WORD_END}")],
          url=[("static.parastorage.com", r"^https?://static\.parastorage\.com/", "static.parastorage.com asset")]),
    _tech("squarespace", "Squarespace", "platform", header=[("server", f"^Squarespace{_WORD_END}")],
          url=[("squarespace.com", rf"^https?://(?:static1|assets)\.squarespace\.com/[^?#\s]*\.(?:js|css){_FILE_END}", "squarespace.com script")],
          inline=[("squarespace_context", rf"(?<![A-Za-z0-9_])SQUARESPACE_CONTEXT{_WORD_END}", "Static.SQUARESPACE_CONTEXT")]),
    _tech("webflow", "Webflow", "platform", dom=[("wfSite", "data-wf-site attribute")], live=[("webflow", "live Webflow global")],
          generator=[("webflow", f"^Webflow{_WORD_END}", "generator")],
          url=[("website-files.com", rf"website-files\.com/[^?#\s]*\.(?:js|css){_FILE_END}", "website-files.com asset")]),
    _tech("framer", "Framer", "platform", header=[("server", f"^Framer{_WORD_END}")],
          generator=[("framer", f"^Framer{_WORD_END}", "generator")],
          url=[("framerusercontent.com", rf"^https?://framerusercontent\.com/[^?#\s]*\.m?js{_FILE_END}", "framerusercontent.com script")]),
    _tech("ghost", "Ghost", "platform",
          generator=[("ghost", rf"^Ghost(?:\s+{_VN})?{_STOP}", "generator")],
          url=[("/ghost/", "/ghost/(?:portal|sodo-search)@", "Ghost Portal script"),
               ("/public/cards", r"/public/cards\.min\.(?:js|css)", "Ghost cards asset")]),
    _tech("hubspot-cms", "HubSpot CMS", "platform",
          generator=[("hubspot", f"^HubSpot{_WORD_END}", "generator")],
          url=[("/_hcms/", "^https?://[^/]+/_hcms/", "/_hcms/ request"), ("/hs/hsstatic/", "^https?://[^/]+/hs/hsstatic/", "/hs/hsstatic/ asset")]),
    # ---- frameworks and libraries
    _tech("nextjs", "Next.js", "framework", implies=("react",), npm="next", live=[("next.version", "window.next.version", "version")],
          header=[("x-powered-by", rf"^Next\.js(?:\s+{_VN})?"), *_any("x-nextjs-cache", "x-nextjs-prerender")],
          dom=[("nextData", "#__NEXT_DATA__ script (pages router)")],
          inline=[("self.__next_f", rf"(?<![A-Za-z0-9_])self\.__next_f{_WORD_END}", "self.__next_f payload (app router)")],
          url=[("/_next/static/", "/_next/static/", "/_next/static/ asset")]),
    _tech("nuxt", "Nuxt", "framework", implies=("vue",), npm="nuxt",
          live=[("nuxt.version", "#__nuxt app, $nuxt.versions.nuxt", "version"), ("nuxt", "live __NUXT__ or $nuxt global")],
          dom=[("nuxtRoot", "#__nuxt element"), ("nuxtData", "#__NUXT_DATA__ script")], header=[("x-powered-by", f"^Nuxt{_WORD_END}")],
          inline=[("window.__nuxt__", r"(?<![A-Za-z0-9_])window\.__NUXT__\s*=", "window.__NUXT__ payload")],
          url=[("/_nuxt/", "/_nuxt/", "/_nuxt/ asset")]),
    _tech("astro", "Astro", "framework", npm="astro",
          generator=[("astro", r"^Astro\s+v(\d+\.\d+\.\d+(?:-[A-Za-z0-9_.]+)?)", "generator")],
          dom=[("astroIsland", "<astro-island> elements"), ("astroCid", "data-astro-cid-* attributes")],
          url=[("/_astro/", "^https?://[^/]+/_astro/", "/_astro/ asset")]),
    _tech("sveltekit", "SvelteKit", "framework", implies=("svelte",), live=[("sveltekit", "live __sveltekit_* global")],
          dom=[("svelteKitAttr", "data-sveltekit-* attributes")],
          inline=[("__sveltekit_", rf"(?<![A-Za-z0-9_])__sveltekit_[a-z0-9]+{_WORD_END}", "__sveltekit_ bootstrap script")],
          url=[("/_app/immutable/", "/_app/immutable/", "/_app/immutable/ asset")]),
    _tech("svelte", "Svelte", "framework", live=[("svelte.version", "window.__svelte.v (major version only)", "version")]),
    _tech("gatsby", "Gatsby", "framework", implies=("react",), npm="gatsby", live=[("gatsby", "live ___loader global")],
          generator=[("gatsby", rf"^Gatsby\s+{_V3}", "generator")], dom=[("gatsbyRoot", "#___gatsby element")],
          url=[("/page-data/", r"/page-data/[^?#\s]*\.json", "page-data request")]),
    _tech("remix", "Remix / React Router", "framework", implies=("react",),
          live=[("reactrouter.version", "window.__reactRouterVersion (major version only)", "version"),
                ("remix", "live __remixContext global"), ("reactrouter", "live __reactRouterContext global")],
          inline=[(f"window.__{n.lower()}context", rf"(?<![A-Za-z0-9_])window\.__{n}Context\s*=", "router context script") for n in ("remix", "reactRouter")]),
    _tech("angular", "Angular", "framework", npm="@angular/core", dom=[("ngVersion", "ng-version attribute", "version")]),
    _tech("vue", "Vue", "framework", npm="vue", dom=[("vueApp", "data-v-app attribute")],
          live=[("vue.version", "live __vue_app__.version", "version"), ("nuxt.vue", "#__nuxt app, $nuxt.versions.vue", "version"),
                ("vue2.version", "live Vue.version", "version")]),
    _tech("react", "React", "framework", dom=[("reactRoot", "data-reactroot attribute")],
          live=[("react.version", "live React.version", "version"), ("react", "React fiber on DOM nodes")]),
    _tech("preact", "Preact", "framework", live=[("preact", "Preact vnode on DOM nodes"), ("preact.global", "live preact global")]),
    _tech("alpine", "Alpine.js", "framework", live=[("alpine.version", "window.Alpine.version", "version")],
          url=[("/alpine", rf"/alpinejs@{_V3}/", "alpinejs script"), ("/alpine", rf"/alpine(?:js)?(?:\.min)?\.js{_FILE_END}", "alpine.js script")]),
    _tech("htmx", "htmx", "framework", live=[("htmx.version", "window.htmx.version", "version")], dom=[("htmxAttr", "hx-* attributes")],
          url=[("/htmx", rf"/htmx\.org@{_V3}/", "htmx.org script"), ("/htmx", rf"/htmx(?:\.min)?\.js{_FILE_END}", "htmx.js script")]),
    _tech("jquery", "jQuery", "framework", npm="jquery", live=[("jquery.version", "jQuery.fn.jquery", "version")],
          url=[("/jquery", rf"/wp-includes/js/jquery/jquery(?:\.min)?\.js{_VERQ}{_V3}{_STOP}", "WordPress jquery.js"),
               ("/jquery", rf"/jquery[.-]{_V3}(?:\.slim)?(?:\.min)?\.js{_FILE_END}", "jquery-X.js"),
               ("/jquery", rf"/ajax/libs/jquery/{_V3}/", "jQuery from a CDN"), ("/jquery", rf"/jquery@{_V3}/", "jQuery from a CDN")]),
    _tech("gsap", "GSAP", "framework", live=[("gsap.version", "window.gsap.version", "version")],
          url=[("/gsap", rf"/gsap@{_V3}/", "GSAP from a CDN"), ("/gsap", rf"/ajax/libs/gsap/{_V3}/", "GSAP from a CDN"),
               ("/gsap", rf"/gsap(?:\.min)?\.js{_FILE_END}", "gsap.js script")]),
    # ---- CMS plugins: folder names, directory slug (False: not listed), REST namespace prefixes
    _tech("elementor", "Elementor", "plugin", wp=("elementor",), wporg="elementor",
          generator=[("elementor", rf"^Elementor\s+{_V3}", "generator")], live=[("elementor.version", "elementorFrontendConfig.version", "version")]),
    _tech("elementor-pro", "Elementor Pro", "plugin", wp=("elementor-pro",), wporg=False),
    _tech("wpbakery", "WPBakery", "plugin", wp=("js_composer",), wporg=False,
          generator=[("wpbakery", "^Powered by WPBakery Page Builder", "generator")], body=[("js-comp-ver-", rf"{_CLASS}js-comp-ver-{_VN}", "body class")]),
    _tech("divi", "Divi", "plugin", wp=("divi-builder",), wporg=False,
          generator=[("divi", rf"^Divi\s+v\.?{_VN}", "generator")], url=[("/themes/divi/", "/themes/Divi/", "Divi theme asset")],
          body=[("et_divi_theme", rf"{_CLASS}et_divi_theme{_CLASS_END}", "body class")]),
    _tech("beaver-builder", "Beaver Builder", "plugin", wp=("bb-plugin", "beaver-builder-lite-version"), wporg="beaver-builder-lite-version",
          body=[("fl-builder", rf"{_CLASS}fl-builder{_CLASS_END}", "body class")]),
    _tech("bricks", "Bricks", "plugin", wporg=False, url=[("/themes/bricks/", "/themes/bricks/", "Bricks theme asset")],
          body=[("brx-body", rf"{_CLASS}brx-body{_CLASS_END}", "body class")]),
    _tech("yoast", "Yoast SEO", "plugin", wp=("wordpress-seo", "wordpress-seo-premium"), wporg="wordpress-seo", ns=("yoast/",),
          comment=[("yoast seo", r"optimized with the Yoast SEO(?: Premium)? plugin v(\d+\.\d+(?:\.\d+)?(?:-RC\d+)?)", "comment")]),
    _tech("rank-math", "Rank Math", "plugin", wp=("seo-by-rank-math", "seo-by-rank-math-pro"), wporg="seo-by-rank-math", ns=("rankmath/",),
          comment=[("rank math", "Search Engine Optimization by Rank Math", "comment")]),
    _tech("aioseo", "All in One SEO", "plugin", wp=("all-in-one-seo-pack", "all-in-one-seo-pack-pro"), wporg="all-in-one-seo-pack", ns=("aioseo/",),
          generator=[("all in one seo", rf"^All in One SEO(?: Pro)?(?: \(AIOSEOP?\))?\s+{_VN}", "generator")],
          comment=[("all in one seo", rf"All in One SEO(?: Pro)?\s+{_VN}", "comment")]),
    _tech("wpml", "WPML", "plugin", wp=("sitepress-multilingual-cms",), wporg=False, ns=("wpml/",), generator=[("wpml", f"^WPML ver:{_VN}", "generator")]),
    _tech("polylang", "Polylang", "plugin", wp=("polylang", "polylang-pro"), wporg="polylang", ns=("pll/",)),
    _tech("cf7", "Contact Form 7", "plugin", wp=("contact-form-7",), wporg="contact-form-7", ns=("contact-form-7/",)),
    _tech("gravityforms", "Gravity Forms", "plugin", wp=("gravityforms",), wporg=False, ns=("gf/",)),
    _tech("wpforms", "WPForms", "plugin", wp=("wpforms-lite", "wpforms"), wporg="wpforms-lite", ns=("wpforms/",)),
    _tech("ninja-forms", "Ninja Forms", "plugin", wp=("ninja-forms",), wporg="ninja-forms", ns=("ninja-forms",)),
    _tech("revslider", "Slider Revolution", "plugin", wp=("revslider",), wporg=False,
          generator=[("slider revolution", rf"^Powered by Slider Revolution\s+{_VN}", "generator")]),
    _tech("wp-rocket", "WP Rocket", "plugin", wp=("wp-rocket",), wporg=False,
          comment=[("by wp rocket", "optimized by WP Rocket", "comment"), ("like a rocket", "This website is like a Rocket", "comment")]),
    _tech("litespeed-cache", "LiteSpeed Cache", "plugin", wp=("litespeed-cache",), wporg="litespeed-cache",
          comment=[("litespeed cache", rf"Page (?:optimized|cached|generated) by LiteSpeed Cache(?:\s+{_VN})?", "comment")]),
    _tech("w3tc", "W3 Total Cache", "plugin", wp=("w3-total-cache",), wporg="w3-total-cache",
          comment=[("w3 total cache", "optimized by W3 Total Cache", "comment")], header=[("x-powered-by", f"W3 Total Cache(?:/{_VN})?")]),
    *[_tech(i, n, "plugin", wp=dirs, wporg=dirs[0], ns=(prefix,)) for i, n, dirs, prefix in [
        ("wordfence", "Wordfence", ("wordfence",), "wordfence/"), ("jetpack", "Jetpack", ("jetpack",), "jetpack/"),
        ("akismet", "Akismet", ("akismet",), "akismet/"), ("ai1wm", "All-in-One WP Migration", ("all-in-one-wp-migration",), "ai1wm/"),
        ("smush", "Smush", ("wp-smushit", "wp-smush-pro"), "wp-smush/"), ("redirection", "Redirection", ("redirection",), "redirection/")]],
    # ---- hosting, CDN, server and language: response headers alone
    *[_tech(i, n, "hosting", header=h) for i, n, h in [
        ("cloudflare", "Cloudflare", [*_any("cf-ray"), ("server", f"^cloudflare{_WORD_END}"), *_any("cf-cache-status")]),
        ("vercel", "Vercel", [*_any("x-vercel-id", "x-vercel-cache"), ("server", f"^Vercel{_WORD_END}")]),
        ("netlify", "Netlify", [*_any("x-nf-request-id"), ("server", f"^Netlify{_WORD_END}")]),
        ("wp-engine", "WP Engine", [("x-powered-by", f"^WP Engine{_WORD_END}"), *_any("wpe-backend")]),
        ("kinsta", "Kinsta", _any("x-kinsta-cache")),
        ("wordpress-vip", "WordPress VIP", [("x-powered-by", f"^WordPress VIP{_WORD_END}")]),
        ("pantheon", "Pantheon", _any("x-pantheon-styx-hostname", "x-styx-req-id")),
        ("elementor-cloud", "Elementor Cloud", [("x-powered-by", f"^Elementor Cloud{_WORD_END}")]),
        ("fly", "Fly.io", [*_any("fly-request-id"), ("server", "^Fly/")]),
        ("cloudfront", "CloudFront", [*_any("x-amz-cf-id"), ("via", r"\(CloudFront\)"), ("x-cache", f"(?<![A-Za-z0-9_])from cloudfront{_WORD_END}")]),
        ("fastly", "Fastly", [("x-served-by", r"^cache-[a-z0-9-]+\z"), *_any("x-fastly-request-id")]),
        ("akamai", "Akamai", [("server", f"^Akamai(?:GHost|NetStorage){_WORD_END}"), *_any("akamai-grn", "x-akamai-transformed", "akamai-cache-status")]),
        ("github-pages", "GitHub Pages", [("server", r"^GitHub\.com\z"), *_any("x-github-request-id")])]],
    *[_tech(i, n, "server", header=h) for i, n, h in [
        ("nginx", "nginx", [("server", f"^nginx(?:/{_VN})?{_STOP}")]),
        ("apache", "Apache", [("server", f"^Apache(?:/{_VN})?(?![A-Za-z0-9_.-])")]),
        ("litespeed", "LiteSpeed", [("server", f"^LiteSpeed{_WORD_END}")]),
        ("iis", "IIS", [("server", f"^Microsoft-IIS(?:/{_VN})?{_STOP}")]),
        ("openresty", "OpenResty", [("server", f"^openresty(?:/{_VN})?{_STOP}")]),
        ("caddy", "Caddy", [("server", f"^Caddy{_WORD_END}"), ("via", f"(?<![A-Za-z0-9_])Caddy{_WORD_END}")]),
        ("php", "PHP", [("x-powered-by", f"^PHP(?:/{_VN})?{_STOP}")]),
        ("aspnet", "ASP.NET", [("x-powered-by", rf"^ASP\.NET{_WORD_END}"), ("x-aspnet-version", f"^{_VN}")]),
        ("express", "Express", [("x-powered-by", f"^Express{_WORD_END}")])]],
]

TEXT_USES = ("generator", "url", "inline", "comment", "body")


def pattern_rows(catalog: list[dict] | None = None) -> list[dict]:
    """Text patterns, matched case-insensitively."""
    out = []
    for t in catalog or TECH:
        for use in TEXT_USES:
            for i, (token, regex, label, *rank) in enumerate(t["sources"].get(use, [])):
                out.append(dict(use=use, token=token, tech=t["id"], pat_ord=i, regex=f"(?i){regex}", groups=group_count(regex),
                                label=label, rank=rank[0] if rank else RANK[use]))
    return out


def validate(catalog: list[dict]) -> list[dict]:
    """Unique ids, known groups and implied ids, well-formed patterns."""
    ids = [t["id"] for t in catalog]
    if len(set(ids)) != len(ids):
        raise ValueError("duplicate technology id")
    if unknown := {t["group"] for t in catalog} - set(GROUPS):
        raise ValueError(f"unknown group {sorted(unknown)}")
    if missing := {i for t in catalog for i in t["implies"]} - set(ids):
        raise ValueError(f"unknown implied technology {sorted(missing)}")
    pattern_rows(catalog)
    return catalog


PATTERN_SCHEMA = "use string, token string, tech string, pat_ord int, regex string, groups int, label string, rank int"


def header_rows(catalog: list[dict] | None = None) -> list[dict]:
    """Header patterns, matched case-insensitively in parts of the header's value."""
    return [dict(header=n, tech=t["id"], pat_ord=i, regex=f"(?i){p}", groups=group_count(p)) for t in catalog or TECH for i, (n, p) in enumerate(t["sources"].get("header", []))]


def key_table(spark: SparkSession, use: str, catalog=None) -> DataFrame:
    """dom or live keys."""
    rows = [(k, t["id"], i, label, bool(v)) for t in catalog or TECH for i, (k, label, *v) in enumerate(t["sources"].get(use, []))]
    return spark.createDataFrame(rows, "key string, tech string, pat_ord int, label string, is_version boolean")


def tech_table(spark: SparkSession, catalog=None) -> DataFrame:
    rows = [(t["id"], i, GROUPS.index(t["group"]), t["name"], t["group"], t["npm"], t["wporg"] or None, t["wp"][0] if t["wp"] else None)
            for i, t in enumerate(catalog or TECH)]
    return spark.createDataFrame(rows, "tech string, cat_ord int, group_ord int, name string, `group` string, npm string, wporg string, wp_dir string")


def implies_table(spark: SparkSession, catalog=None) -> DataFrame:
    rows = [(t["id"], i, t["name"]) for t in catalog or TECH for i in (*t["implies"], *(("wordpress",) if t["group"] == "plugin" else ()))]
    return spark.createDataFrame(rows, "tech string, implied string, by_name string")


def dir_table(spark: SparkSession, catalog=None) -> DataFrame:
    """Plugin folder (lower case) -> technology."""
    rows = [(d.lower(), t["id"]) for t in catalog or TECH for d in t["wp"]]
    return spark.createDataFrame(rows, "dir_key string, tech string")
