"""codequery.operators"""
