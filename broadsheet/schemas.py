"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

LINES = (
    "line_id string, text string, text_block_id string, page_id string, filename string, date timestamp, year int, month int, day int, "
    "x int, y int, width int, height int, newspaper_id string, issue_number int, daily_issue_number int, page_number int, "
    "year_volume string, page_count int, newspaper_title string, newspaper_subtitle string"
)
ISSUES = (
    "filename string, path string, date timestamp, issue_string string, issue_number int, edition string, year_volume string, page_count int, "
    "newspaper_title string, newspaper_subtitle string, newspaper_id string, language string"
)
ENTITIES = "line_id string, entity_text string, entity_type string, confidence double"
TOPICS = "line_id string, primary_topic string, secondary_topics array<string>, confidence double"
TOPIC_CSV = "year string, month string, day string, issue string, topics string, subtopics string, path string"
UI_ENTITIES = "Date string, Type string, Entity string"
EMOTION_NAMES = ("Agitation", "Anger", "Fear", "Joy", "Love", "Sadness")
EMOTION_MEANS = "id string, " + ", ".join(f"mean_{e} double" for e in EMOTION_NAMES) + ", year int, era1 string, era2 string"
EMOTION_MEANS_RAW = "id string, " + ", ".join(f"mean_{e} string" for e in EMOTION_NAMES) + ", year string, era1 string, era2 string"

_BBOX = "struct<x1:double,y1:double,x2:double,y2:double,width:double,height:double>"
PAIRS = (
    f"fulltext_basename string, source_image string, source_fulltext string, picture struct<confidence:double,bbox:{_BBOX},crop_file:string>, "
    f"caption struct<confidence:double,bbox:{_BBOX},text_content:string,crop_file:string>, spatial_relationship struct<distance:double,vertical_distance:double>"
)
LAYOUT = (
    "image_file string, date string, total_detections int, summary struct<by_class:map<string,int>>, "
    "detections array<struct<class:string,confidence:double,bbox:struct<x1:double,y1:double,x2:double,y2:double>,text_content:string>>"
)
NER = "date string, entities array<struct<text:string,label:string,start:int,end:int,score:double>>"

# answers of language models, for from_json
RESPONSES = {
    "entities": "persons array<string>, locations array<string>, organizations array<string>",
    "topic": "primary_topic string, secondary_topics array<string>, confidence double",
    "topics": "topics array<string>, main_theme string",
    "emotion": "sentiment string, emotions array<string>, intensity double, tone string",
    "concepts": "concepts array<string>, relationships array<struct<source:string,target:string,type:string>>",
    "summary": "summary string, key_points array<string>, historical_context string",
    "quality": "quality_score double, ocr_errors string, coherence string, issues array<string>, readable boolean",
}
