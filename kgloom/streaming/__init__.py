"""kgloom.streaming"""
