"""The checks: identifiers, severities and what each weighs in the health score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One line a check: id, severity, weight class, name.
CHECKS = """
[response_codes]
internal_server_error | critical | broken | 5xx Server Errors
internal_client_error | critical | broken | 4xx Client Errors
internal_access_restricted | warning | site_medium | Access-Restricted or Rate-Limited
internal_redirect_loop | critical | broken | Redirect Loops
internal_no_response | critical | broken | No Response
internal_redirect_chain | warning | site_medium | Long Redirect Chains
internal_redirect | info | minor | 3xx Redirects
[security]
http_urls | warning | defective | HTTP Pages (Not Secure)
mixed_content | warning | site_high | Mixed Content
insecure_form_action | warning | site_high | Insecure Form Actions
form_on_http | warning | site_high | Forms on HTTP Pages
unsafe_cross_origin | info | unscored | Unsafe Cross-Origin Links
missing_hsts | info | unscored | Missing HSTS Header
missing_csp | info | unscored | Missing CSP Header
missing_x_content_type_options | info | unscored | Missing X-Content-Type-Options
missing_x_frame_options | info | unscored | Missing X-Frame-Options
missing_referrer_policy | info | unscored | Missing or Unsafe Referrer-Policy
[url]
contains_space | warning | site_medium | URLs with Spaces
over_115_chars | info | minor | URLs Over 115 Characters
contains_uppercase | info | minor | URLs with Uppercase
contains_underscores | info | minor | URLs with Underscores
has_parameters | info | unscored | URLs with Parameters
multiple_slashes | info | minor | Consecutive Slashes
non_ascii | info | minor | Non-ASCII Characters
repetitive_path | info | minor | Repetitive Path Segments
ga_tracking_params | info | unscored | GA Tracking Parameters
[page_titles]
missing | warning | defective | Missing Title Tag
duplicate | warning | site_medium | Duplicate Titles
multiple_tags | warning | site_medium | Multiple Title Tags
outside_head | warning | site_medium | Title Outside Head
over_60_chars | info | minor | Over 60 Characters
below_30_chars | info | minor | Below 30 Characters
over_561_pixels | info | minor | Over 561px Wide
below_200_pixels | info | minor | Below 200px Wide
[meta_description]
missing | warning | minor | Missing Meta Description
duplicate | warning | minor | Duplicate Descriptions
multiple_tags | warning | minor | Multiple Meta Descriptions
outside_head | warning | minor | Meta Description Outside Head
over_155_chars | info | minor | Over 155 Characters
below_70_chars | info | minor | Below 70 Characters
over_985_pixels | info | minor | Over 985px Wide
[headings]
h1_missing | warning | minor | Missing H1
h1_multiple | warning | minor | Multiple H1 Tags
h1_duplicate | warning | minor | Duplicate H1 Headings
h1_same_as_title | info | minor | H1 Same as Title
h1_over_70_chars | info | minor | H1 Over 70 Characters
h2_missing | info | minor | Missing H2
h2_duplicate | info | minor | Duplicate H2 Headings
h2_over_70_chars | info | minor | H2 Over 70 Characters
non_sequential | info | minor | Non-Sequential Headings
[content]
exact_duplicate | warning | defective | Duplicate Content
soft_404 | warning | defective | Soft 404 Pages
low_content | warning | site_medium | Low Word Count
readability_very_difficult | info | minor | Very Difficult Readability
readability_difficult | info | minor | Difficult Readability
[images]
missing_alt_attribute | warning | minor | Missing Alt Text
alt_over_100_chars | info | minor | Alt Text Over 100 Characters
missing_dimensions | info | minor | Missing Image Dimensions
[canonicals]
canonical_outside_head | warning | site_medium | Canonical Outside Head
canonical_loop | warning | site_medium | Canonical Loop
canonical_chain | warning | site_medium | Canonical Chain
non_indexable_target | critical | broken | Canonical to Non-Indexable
multiple_conflicting | warning | site_high | Multiple Canonical Tags
canonical_relative | warning | site_medium | Relative Canonical URLs
canonical_mismatch | info | minor | Canonical Declared Twice
missing | warning | site_medium | Missing Canonical Tag
canonicalised | info | minor | Canonicalised to Different URL
[directives]
conflicting_directives | warning | broken | Conflicting Index Directives
conflicting_follow_directives | warning | site_medium | Conflicting Follow Directives
noindex | info | minor | Noindex Pages
nofollow | info | minor | Nofollow Pages
none | info | minor | None Directive (Noindex + Nofollow)
nosnippet | info | minor | Nosnippet Pages
noimageindex | info | minor | Noimageindex Pages
ai_crawlers_blocked | info | unscored | AI Crawlers Blocked in robots.txt
noai_directive | info | unscored | AI Opt-Out (noai) Directive
[hreflang]
missing_return_links | warning | site_medium | Missing Return Links
incorrect_lang_codes | warning | site_medium | Invalid Language Codes
non_200_urls | warning | site_medium | Hreflang to Non-200 Pages
non_canonical_urls | warning | site_medium | Hreflang to Non-Canonical
noindex_urls | warning | site_medium | Hreflang to Noindex Pages
multiple_entries | warning | site_medium | Duplicate Language Entries
conflicting_lang_declarations | warning | site_medium | Conflicting Hreflang Languages
missing_self_reference | info | minor | Missing Self-Reference
missing_x_default | info | minor | Missing x-default
[links]
broken_internal | critical | site_high | Broken Internal Links
localhost_outlinks | warning | site_medium | Localhost Links
orphan_pages | warning | defective | Orphan Pages
no_internal_outlinks | warning | site_medium | No Internal Outlinks
no_anchor_text | info | minor | Empty Anchor Text
non_descriptive_anchor | info | minor | Non-Descriptive Anchors
internal_nofollow | info | minor | Internal Nofollow Links
high_crawl_depth | info | minor | High Crawl Depth (5+)
high_external_outlinks | info | minor | Excessive External Links
[structured_data]
parse_errors | warning | site_medium | Schema Parse Errors
missing_required | warning | minor | Missing Required Fields
missing | info | minor | No Structured Data
[sitemaps]
no_sitemap_found | warning | site_medium | No Sitemap Found
sitemap_unreachable | warning | minor | Declared Sitemap Unreachable
sitemap_parse_error | warning | minor | Sitemap XML Parse Error
sitemap_invalid_loc | warning | minor | Invalid Sitemap URL
sitemap_empty | warning | minor | Empty Sitemap
non_indexable_in_sitemap | warning | site_medium | Non-Indexable in Sitemap
over_50k_urls | warning | site_medium | Sitemap Over 50k URLs
over_50mb | warning | site_medium | Sitemap Over 50 MB
urls_not_in_sitemap | info | minor | Pages Not in Sitemap
url_in_multiple_sitemaps | info | minor | URLs in Multiple Sitemaps
[performance]
slow_server_response | warning | site_medium | Slow Server Response
cwv_lcp_poor | critical | site_medium | LCP exceeds 4.0s (Poor)
cwv_lcp_needs_work | warning | minor | LCP exceeds 2.5s
cwv_inp_poor | critical | site_medium | INP exceeds 500ms (Poor)
cwv_inp_needs_work | warning | minor | INP exceeds 200ms
cwv_cls_poor | critical | site_medium | CLS exceeds 0.25 (Poor)
cwv_cls_needs_work | warning | minor | CLS exceeds 0.1
cwv_fcp_slow | warning | minor | FCP exceeds 3.0s
cwv_ttfb_slow | warning | minor | TTFB exceeds 800ms
cwv_score_poor | critical | site_medium | Performance score below 50
cwv_score_needs_work | warning | minor | Performance score below 90
[javascript]
js_injected_title | warning | site_medium | Title injected by JavaScript
js_injected_description | warning | site_medium | Meta description injected by JavaScript
js_injected_canonical | critical | site_medium | Canonical injected by JavaScript
js_injected_h1 | warning | site_medium | H1 injected by JavaScript
js_injected_structured_data | warning | site_medium | Structured data injected by JavaScript
js_render_blocking | warning | minor | Render-blocking scripts
js_excessive_scripts | warning | minor | Excessive JavaScript
js_third_party_heavy | warning | minor | Heavy third-party scripts
js_console_errors | warning | minor | JavaScript console errors
js_console_errors_critical | critical | minor | Critical JavaScript errors
"""
SEVERITY_RANK = {"critical": 0, "warning": 1, "info": 2}


def rows() -> list[tuple[str, str, str, str, str]]:
    """(category, check, severity, tier, name) of each check. A check id may stand in several categories."""
    out, category = [], ""
    for line in CHECKS.strip().splitlines():
        if line.startswith("["):
            category = line.strip("[]")
        else:
            check, severity, tier, name = (x.strip() for x in line.split("|"))
            out.append((category, check, severity, tier, name))
    return out


SEVERITY = {(category, check): severity for category, check, severity, _, _ in rows()}


def catalog(spark: SparkSession) -> DataFrame:
    """The checks as a table; its size is fixed, so it may be broadcast."""
    return spark.createDataFrame(rows(), "category string, check string, severity string, tier string, name string")
