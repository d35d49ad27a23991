"""codequery.functions"""
