"""codequery.plans"""
