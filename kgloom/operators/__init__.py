"""kgloom.operators"""
