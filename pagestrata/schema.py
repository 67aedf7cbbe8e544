"""The page record and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_FIELDS = {
    "page_id": "bigint", "crawl_id": "bigint", "domain": "string", "url": "string", "status": "int",
    "redirect_chain": "array<struct<status:int,url:string>>", "response_time_ms": "bigint", "content_type": "string", "depth": "int",
    "title": "string", "meta_description": "string", "meta_robots": "string", "canonical": "string",
    "h1": "array<string>", "headings": "array<struct<level:int,text:string>>",
    "word_count": "int", "body_text": "string", "content_hash": "string", "readability_score": "float", "is_soft_404": "boolean",
    "internal_links": "array<struct<url:string,anchor:string,nofollow:boolean>>",
    "external_links": "array<struct<url:string,anchor:string,nofollow:boolean>>",
    "unsafe_cross_origin_links": "array<string>",
    "images": "array<struct<src:string,alt:string,width:int,height:int>>",
    "schema_types": "array<string>",
    "structured_data": "array<struct<format:string,schema_type:string,raw:string,parse_error:string,missing_required:array<string>>>",
    "og_tags": "map<string,string>",
    "is_https": "boolean",
    "security_headers": "struct<hsts:boolean,csp:boolean,x_content_type_options:boolean,x_frame_options:boolean,referrer_policy:boolean,referrer_value:string>",
    "mixed_content": "array<string>", "insecure_forms": "array<string>",
    "title_length": "int", "title_pixel_width": "int", "meta_description_length": "int", "meta_description_pixel_width": "int",
    "title_count": "int", "meta_description_count": "int", "title_in_head": "boolean", "meta_desc_in_head": "boolean",
    "canonical_is_relative": "boolean", "canonical_count": "int", "canonical_source": "string", "has_self_canonical": "boolean",
    "x_robots_tag": "string", "meta_robots_directives": "array<string>",
    "hreflang_tags": "array<struct<lang:string,url:string>>", "pagination": "struct<prev:string,next:string>",
    "lcp_ms": "double", "inp_ms": "double", "cls": "double", "fcp_ms": "double", "ttfb_ms": "double", "performance_score": "int", "cwv_status": "string",
    "js_injected_title": "boolean", "js_injected_description": "boolean", "js_injected_canonical": "boolean", "js_injected_h1": "boolean",
    "js_injected_structured_data": "boolean", "console_errors": "array<string>",
    "scripts": "array<struct<src:string,is_async:boolean,is_defer:boolean,is_module:boolean,in_head:boolean,size_bytes:int,is_third_party:boolean>>",
}


def complete(pages: DataFrame) -> DataFrame:
    """All page fields, those a source lacks as nulls, and nothing else."""
    present = set(pages.columns)
    return pages.select(*[(F.col(n) if n in present else F.lit(None)).cast(t).alias(n) for n, t in PAGE_FIELDS.items()])
