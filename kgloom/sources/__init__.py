"""kgloom.sources"""
