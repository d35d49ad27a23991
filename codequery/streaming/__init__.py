"""codequery.streaming"""
