"""kgloom.plans"""
