"""codequery.sources"""
