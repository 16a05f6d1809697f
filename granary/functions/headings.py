"""What headings are known by. Results depend on each pattern as it is written here.

They hold for Python and for Spark alike; ``(?i)`` stands for a match without case, ``(?is)`` for one that also runs over lines.
"""

CHAPTER = r"^第\s*[一二三四五六七八九十百千零0-9]+\s*[章部分]"
NUMERAL = r"^[一二三四五六七八九十百]+\s*[、，]\s*\S"
ARTICLE = r"^第\s*[一二三四五六七八九十百千零0-9]+\s*条"
APPENDIX = r"^附\s*录\s*(?:[A-J]|[一二三四五六七八九十百千0-9]+|（[一二三四五六七八九十百千0-9]+）|\([A-J0-9]+\))"
REFERENCE = r"(?i)^\s*(?:参考文献|参考书目|参考资料|Reference)"
PREFACE = r"^\s*(?:前\s*言|序\s*言|序\s*$)\s*$"
TOC = r"^\s*(?:目\s*录|目\s*次)\s*$"
NUMERIC = r"^(\d+(?:\.\d+){0,2})(?:\s|$)"
ENGLISH_LEVEL_1 = (
    r"(?i)^\s*(?:ABSTRACT|INTRODUCTION|CONCLUSION[S]?|DISCUSSION|METHOD[S]?|RESULT[S]?|MATERIAL[S]?\s+AND\s+METHOD[S]?|BACKGROUND|OBJECTIVE[S]?|PURPOSE|AIM[S]?|REFERENCES?|BIBLIOGRAPHY"
    r"|ACKNOWLEDGEMENT[S]?|ACKNOWLEDGMENT[S]?|APPENDIX[A-Z]?|CONTENTS|TABLE\s+OF\s+CONTENTS|LIST\s+OF\s+FIGURES|LIST\s+OF\s+TABLES|ABBREVIATIONS|GLOSSARY|PREFACE|FORWARD|PROLOGUE"
    r"|EXECUTIVE\s+SUMMARY|RECOMMENDATION[S]?|KEY\s+RECOMMENDATION[S]?|SCOPE|NORMATIVE\s+REFERENCES?|TERMS\s+AND\s+DEFINITIONS|DEFINITIONS|ABBREVIATIONS\s+AND\s+ACRONYMS)\s*$"
)
PAPER_HEADER = (
    r"(?i)^\s*(?:Accepted\s+Manuscript|Original\s+Article|Review\s+Article|Case\s+Report|Brief\s+Communication|Letter\s+to\s+the\s+Editor|ACCEPTED\s+MANUSCRIPT|Manuscript|PREPRINT|Page\s+\d+"
    r"|©\s*\d{4}|Copyright|Confidential|Draft|Working\s+Paper|Technical\s+Report)\s*$"
)
IDENTIFIER_LINE = r"(?i)^\s*(?:Reference|Ref|PII|DOI|Article\s+ID|Article\s+No)[ #:.][\s\S]*$"
ENGLISH_REFERENCE = r"(?i)^\s*(?:REFERENCES?|BIBLIOGRAPHY)\s*$"
ENGLISH_PREFACE = r"(?i)^\s*(?:ACKNOWLEDGEMENT[S]?|ACKNOWLEDGMENT[S]?|PREFACE|FOREWORD|PROLOGUE)\s*$"
ENGLISH_APPENDIX = r"(?i)^\s*APPENDIX\s+[A-Z0-9]+\s*$"
NUMBERED = r"^\d+\s+\S"
DOTTED = r"^\d+\.\S*"
COUNTED = r"^[一二三四五六七八九十]+[、，]\s*\S"
SENTENCE_MARKS = r"[;。，；：、!?,:;.]"
#: A cover line that standards repeat before their explanatory part.
STANDARD_COVER = "中国工程建设标准化协会"

#: By the kind of region that a title opens, in the order in which kinds are tried.
KINDS = {"appendix": (APPENDIX, ENGLISH_APPENDIX), "reference": (REFERENCE, ENGLISH_REFERENCE), "preface": (PREFACE, ENGLISH_PREFACE), "toc": (TOC,)}
#: What a chapter's title looks like.
CHAPTER_FORMS = (CHAPTER, ARTICLE, NUMBERED, DOTTED, ENGLISH_LEVEL_1)
