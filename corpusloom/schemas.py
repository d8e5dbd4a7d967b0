"""Declared schemas of the nested records; nothing is ever inferred."""

from __future__ import annotations

# The closed enumerations of a source record.
SOURCE_TYPES = ["academic", "criticism", "festival", "programme"]
ACCESS = ["abstract", "full_page", "metadata_only"]
RIGHTS = ["metadata_only", "noncommercial", "open_license", "restricted_excerpt"]
KINDS = [
    "film_reading", "comparison", "contrast", "influence", "co_programming", "historical_context", "incidental_mention",
]
RELATIONAL = ["comparison", "contrast", "influence", "co_programming"]

EXTERNAL_ID = "struct<provider:string,id:string>"
FILM = f"struct<key:string,title:string,year:int,director:string,aliases:array<string>,externalIds:array<{EXTERNAL_ID}>>"
PASSAGE = "struct<id:string,text:string,locator:string>"
OBSERVATION = (
    "struct<id:string,summary:string,summaryKo:string,boundary:string,filmKeys:array<string>,"
    "subjects:array<string>,kind:string,passageIds:array<string>>"
)
RECORD = (
    "id string, url string, title string, author string, publisher string, type string, language string, "
    "publishedAt string, checkedAt string, access string, "
    "rights struct<mode:string,licenseUrl:string,note:string>, "
    "verification struct<method:string,locator:string,note:string,textUrl:string>, "
    f"films array<{FILM}>, passages array<{PASSAGE}>, observations array<{OBSERVATION}>"
)
REGISTRY = f"version int, films array<struct<key:string,title:string,year:int,director:string,aliases:array<string>,externalIds:array<{EXTERNAL_ID}>,sourceKeys:array<string>>>"
CANDIDATE = (
    "admit boolean, accessAssessment string, "
    "document struct<title:string,author:string,publishedAt:string,language:string,sourceType:string>, "
    "films array<struct<title:string,year:int,director:string,aliases:array<string>,evidencePhrase:string>>, "
    "observations array<struct<kind:string,filmIndexes:array<int>,summary:string,summaryKo:string,boundary:string,"
    "subjects:array<string>,anchorQuote:string,confidence:double>>, rejectionReasons array<string>"
)
MODEL_RESULT = (
    "custom_id string, response struct<status_code:int,body:struct<model:string,"
    "output:array<struct<type:string,content:array<struct<type:string,text:string>>>>,"
    "usage:struct<input_tokens:bigint,output_tokens:bigint,input_tokens_details:struct<cached_tokens:bigint>>>>"
)
