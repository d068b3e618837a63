"""kgloom.functions"""
